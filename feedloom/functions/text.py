"""Text functions: Column in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from feedloom.functions.binding import let

# Whitespace as Unicode text processing defines it, line breaks among it,
# and the word class used when punctuation is dropped.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
LINE_BREAK = r"[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
NOT_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]"
# The same two classes within ASCII, written out so that the matcher tests one bit per character.
ASCII_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f]"
ASCII_NOT_WORD = (
    "[" + "".join(f"\\x{i:02x}" for i in range(128) if not (chr(i).isalnum() or chr(i).isspace() or i == ord("_"))) + "]"
)

# Words left out of fingerprints.
STOP_WORDS = (
    "a an the and or but if because as what when where how why which who whom this that these those "
    "am is are was were be been being have has had having do does did doing to at by for with about "
    "against between into through during before after above below from up down in out on off over "
    "under again further then once here there all any both each few more most other some such no nor "
    "not only own same so than too very can will just should now"
).split()

# What common named entities are written as.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–",
    "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "amp": "&",
}

# Instruction wording by prefix of the model id, and the wording for all other models.
PROMPTS = {
    "anthropic.claude": (
        "Human: Please summarize the following content in about {low}-{high} words. "
        "Focus on the main points and key takeaways:\n            \n            <content>"
        "\n            \n            Assistant:"
    ),
    "amazon.titan": (
        "Summarize the following content in about {low}-{high} words. "
        "Focus on the main points and key takeaways:\n            \n            <content>"
    ),
}
PLAIN_PROMPT = (
    "Summarize the following content in about {low}-{high} words:\n            \n            <content>"
)


def text_or_empty(c) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def strip(c) -> Column:
    """Drop whitespace of any kind at both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(_col(c), rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def holds_at_least(c, n: int) -> Column:
    """Whether ``strip(c)`` has ``n`` characters or more, two at least; only the text's beginning is looked at where they follow
    one another."""
    outer = rf"[^{SPACE[1:]}"
    return _col(c).rlike(rf"(?s)\A{SPACE}*+{outer}.{{{n - 2},}}?{outer}")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def _cut(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(_head(c, limit), F.lit("..."))).otherwise(c)


def sanitise_text(c, limit: int = 5000) -> Column:
    """Trimmed text, cut to ``limit`` characters with an ellipsis; null becomes empty."""
    return _cut(strip(text_or_empty(c)), limit)


def strip_tags(c) -> Column:
    """Remove markup tags; neighbouring words fuse."""
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def _bare(c: Column) -> Column:
    """Drop punctuation and turn all whitespace into blanks; ASCII text takes cheaper patterns."""
    ascii_only = F.length(c) == F.octet_length(c)
    quick = F.regexp_replace(F.regexp_replace(c, ASCII_NOT_WORD, ""), ASCII_SPACE, " ")
    full = F.regexp_replace(F.regexp_replace(c, NOT_WORD, ""), SPACE, " ")
    return F.when(ascii_only, quick).otherwise(full)


def content_words(c) -> Column:
    """Lower-cased words without tags, punctuation and stop words."""
    words = F.split(let(strip_tags(F.lower(_col(c))), _bare), " ")
    return F.filter(words, lambda w: ~w.isin("", *STOP_WORDS))


def process_text(c) -> Column:
    """``content_words`` joined by one blank."""
    return F.array_join(content_words(c), " ")


def clean_html(c) -> Column:
    """Remove script, style and frame blocks together with their content."""
    out = text_or_empty(c)
    for tag in ("script", "style", "iframe"):
        out = F.regexp_replace(out, f"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    return out


def truncate_html(c, length: int = 200) -> Column:
    """Text as it is when its visible part fits, else the visible prefix and an ellipsis."""
    c = text_or_empty(c)
    plain = strip_tags(c)
    return F.when(F.length(plain) <= length, c).otherwise(F.concat(strip(_head(plain, length)), F.lit("...")))


def truncate_text(c, length: int = 200) -> Column:
    """Prefix of ``length`` characters, trimmed, with an ellipsis when something was cut."""
    c = text_or_empty(c)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(strip(_head(c, length)), F.lit("...")))


def _entity_table() -> tuple[str, str]:
    """All named references of HTML 5 that end in a semicolon, as a JSON object, and a regex of those that count without
    one, the longest first. The standard library has the names; ``ENTITIES`` has the last word."""
    closed = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | ENTITIES
    bare = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
    return json.dumps(closed), f"^(?:{'|'.join(bare)})"


def _decode_reference(part: Column, names: str, bare: str) -> Column:
    """The text after an ampersand with the reference it begins with decoded; the ampersand is put back if there is none."""
    number = r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?"
    digits = F.regexp_extract(part, number, 1)
    code = F.when(
        F.lower(_head(digits, 1)) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)
    ).otherwise(digits).try_cast("bigint")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    known = (digits != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    table = F.from_json(F.lit(names), "map<string,string>")
    name, short = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(part, bare, 0)
    return F.coalesce(
        F.when(known, F.concat(char, F.regexp_replace(part, number, ""))),
        F.when(name != "", F.concat(F.try_element_at(table, name), F.substring(part, F.length(name) + 2, F.length(part)))),
        F.when(short != "", F.concat(F.try_element_at(table, short), F.substring(part, F.length(short) + 1, F.length(part)))),
        F.concat(F.lit("&"), part),
    )


def decode_entities(c) -> Column:
    """Decode numeric references and all named ones of HTML 5, each once, in one pass over the pieces between ampersands."""
    names, bare = _entity_table()

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda part: _decode_reference(part, names, bare))
        return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))

    c = _col(c)
    return F.when(F.contains(c, F.lit("&")), let(F.split(c, "&", -1), joined)).otherwise(c)


def collapse_breaks(c) -> Column:
    """Join lines, and phrases two blanks apart, by one blank; trim the ends."""
    gap = rf"(?<!{SPACE}){SPACE}*?(?:{LINE_BREAK}|  ){SPACE}*"
    return strip(F.regexp_replace(_col(c), gap, " "))


def html_to_text(c) -> Column:
    """Visible text of an HTML page, without leaving the JVM.

    Approximate on malformed markup: ``functions.html.page_text`` parses the page.
    """
    out = text_or_empty(c)
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[/A-Za-z!?][^>]*>", "\n")
    return collapse_breaks(let(out, decode_entities))


def looks_like_html(c) -> Column:
    """First visible character opens a tag and some tag closes."""
    return F.coalesce(_col(c).rlike(rf"^{SPACE}*<"), F.lit(False)) & F.contains(text_or_empty(c), F.lit(">"))


def prepare_for_summary(c, max_length: int = 8000, to_text=html_to_text) -> Column:
    """Plain text of at most ``max_length`` characters, ellipsis after a cut."""
    c = text_or_empty(c)
    return _cut(F.when(looks_like_html(c), to_text(c)).otherwise(c), max_length)


def fallback_summary(c, max_length: int = 150) -> Column:
    """Stand-in for a summary: short text unchanged, else its first characters."""
    c = text_or_empty(c)
    return F.when(~holds_at_least(c, 100), c).otherwise(F.concat(_head(c, max_length), F.lit("...")))


def summary_prompt(c, model: Column | str = "", max_length: int = 150) -> Column:
    """Instruction for the summariser; its wording depends on the model family."""
    model = F.lit(model) if isinstance(model, str) else model
    c = text_or_empty(c)

    def fill(template: str) -> Column:
        before, after = template.format(low=max_length // 10, high=max_length // 5).split("<content>")
        return F.concat(F.lit(before), c, F.lit(after))

    filled = fill(PLAIN_PROMPT)
    for prefix, template in PROMPTS.items():
        filled = F.when(F.startswith(model, F.lit(prefix)), fill(template)).otherwise(filled)
    return filled


def escape_template(c) -> Column:
    """Neutralise template delimiters."""
    out = _col(c)
    # Delimiter and its entity form.
    for raw, safe in (
        ("{{", "&#123;&#123;"), ("}}", "&#125;&#125;"), ("{%", "&#123;%"), ("%}", "%&#125;"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_html(c) -> Column:
    """Escape the five characters that are special in HTML."""
    out = _col(c)
    # Character and entity; ampersand comes first.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def title_case(c) -> Column:
    """Capitalise after blanks, hyphens and opening brackets; lower-case the rest."""
    pieces = F.regexp_extract_all(_col(c), F.lit(r"[-\s({\[<]+|[^-\s({\[<]+"), F.lit(0))
    capital = F.transform(
        pieces, lambda p: F.concat(F.upper(_head(p, 1)), F.lower(F.substring(p, 2, 1 << 30)))
    )
    return F.array_join(capital, "")


def byline(author) -> Column:
    """Author worth showing, else null."""
    author = _col(author)
    return F.when((author != "") & (author != "Unknown"), author)


def content_hash(c) -> Column:
    """MD5 of the UTF-8 text in hex: the key of the summary cache."""
    return F.md5(_col(c).cast("binary"))


def safe_file_name(c) -> Column:
    """Reserved characters and parent references become underscores; at most 255 characters."""
    return _head(F.replace(F.regexp_replace(_col(c), r'[<>:"/\\|?*]', "_"), F.lit(".."), F.lit("_")), 255)


def scrub_control(c) -> Column:
    """Control characters become blanks; null becomes the word None."""
    return F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("None")), r"[\x00-\x1f\x7f]", " ")


def valid_email(c) -> Column:
    """Trimmed address, or null when it is missing, too long or malformed."""
    c = strip(c)
    # Fixed value: the accepted address pattern.
    ok = c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z")
    return F.when((F.length(c) <= 254) & ok, c)
