"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.base import (
    AS_OF, AS_OF_SQL, Registry, documents, instant_sql, instant_text, items, table, with_items,
)
from feedloom.functions import dates, scoring, text, urls
from feedloom.session import spread

REGISTRY = Registry()
add = REGISTRY.add

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
BREAK = r"[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words_sql(c: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({c}), '<[^>]+>', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]', '', 'g')"
    return f"list_filter(string_split_regex({plain}, '{SPACE}+'), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w))"


def clean_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for tag in ("script", "style", "iframe"):
        out = f"regexp_replace({out}, '(?s)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    return out


def truncate_html_sql(c: str, n: int = 200) -> str:
    plain = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    return f"CASE WHEN length({plain}) <= {n} THEN {c} ELSE concat({strip_sql(f'substr({plain}, 1, {n})')}, '...') END"


def template_sql(c: str) -> str:
    return (
        f"replace(replace(replace(replace({c}, '{{{{', '&#123;&#123;'), '}}}}', '&#125;&#125;'), "
        f"'{{%', '&#123;%'), '%}}', '%&#125;')"
    )


def escape_sql(c: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        f"'''', '&#39;'), '\"', '&#34;')"
    )


def title_case_sql(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '[-\\s({{\\[<]+|[^-\\s({{\\[<]+'), "
        "lambda p: concat(upper(p[1]), lower(p[2:]))), '')"
    )


def page_text_sql(c: str) -> str:
    out = c
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->|<[/A-Za-z!?][^>]*>', chr(10), 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    return strip_sql(f"regexp_replace({out}, '{SPACE}*(?:{BREAK}|  ){SPACE}*', ' ', 'g')")


def norm_url_sql(c: str) -> str:
    """Good for URLs with plain, distinct keys, as the test tables have them."""
    tracking = ", ".join(f"'{k}'" for k in urls.TRACKING_KEYS)
    params = (
        f"list_filter(string_split(regexp_extract({c}, '\\?([^#]*)', 1), '&'), "
        f"lambda p: regexp_matches(p, '^[^=]*=.+') AND NOT list_contains([{tracking}], lower(split_part(p, '=', 1))))"
    )
    return (
        f"concat(regexp_extract({c}, '^[^?#]*'), "
        f"CASE WHEN len({params}) > 0 THEN concat('?', array_to_string({params}, '&')) ELSE '' END)"
    )


def score_sql(preset) -> str:
    cases = [
        f"CASE WHEN contains(lower(title), '{p}') THEN {tier.title} "
        f"WHEN contains(lower(coalesce(summary, '')), '{p}') THEN {tier.summary} ELSE 0 END"
        for tier in preset
        for p in tier.phrases
    ]
    return f"CAST(least({' + '.join(cases)}, 100) AS INT)"


def digest_date_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} LIKE '____-__-__%' THEN strftime(strptime(substr({c}, 1, 10), '%Y-%m-%d'), '%b %d, %Y') "
        f"ELSE {c} END"
    )


def mentions_sql(phrases, c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id")


@add("f01_sanitise_text", with_items(
    f"SELECT ord, CASE WHEN length(t) > 5000 THEN concat(substr(t, 1, 5000), '...') ELSE t END AS clean "
    f"FROM (SELECT ord, {strip_sql("coalesce(summary, '')")} AS t FROM items)"))
def _(spark, sf):
    return documents(spark, sf).select("ord", text.sanitise_text("summary").alias("clean"))


@add("f02_process_text", with_items(
    f"SELECT ord, array_to_string({words_sql("coalesce(summary, '')")}, ' ') AS words FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", text.process_text(text.text_or_empty("summary")).alias("words"))


@add("f03_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.strip_tags("html").alias("plain"))


@add("f04_clean_html", f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.clean_html("html").alias("clean"))


@add("f05_normalise_url", f"SELECT page_id, {norm_url_sql('url')} AS norm_url FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.normalise_url("url").alias("norm_url"))


@add("f06_netloc", "SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.netloc("url").alias("site"))


@add("f07_parse_published", with_items(f"SELECT ord, {instant_sql('published_ts')} AS at FROM items"))
def _(spark, sf):
    return items(spark, sf).select("ord", instant_text(dates.parse_published("published"), "at"))


# All digits joined, and the first of the five letters that stands anywhere in the text.
@add("f08_relative_age_reference", f"""
SELECT doc_id, {instant_sql(f'''{AS_OF_SQL} - CASE WHEN doc_id % 6 = 0 OR n_chars % 5 = 0 THEN to_hours(n)
  WHEN doc_id % 6 = 1 OR n_chars % 5 = 1 THEN to_days(n) WHEN doc_id % 6 = 2 OR n_chars % 5 = 2 THEN to_days(7 * n)
  WHEN doc_id % 6 = 3 OR n_chars % 5 = 3 THEN to_days(30 * n) ELSE to_days(365 * n) END''')} AS at
FROM (SELECT *, CAST(doc_id % 3 * 10 + n_chars % 10 AS INT) AS n FROM documents WHERE doc_id % 6 <> 5)""")
def _(spark, sf):
    units = F.array(*[F.lit(u) for u in _AGE_UNITS])
    unit = lambda c, n: F.element_at(units, (F.col(c) % n + 1).cast("int"))
    rows = table(spark, sf, "documents").filter("doc_id % 6 <> 5")
    age = F.concat((F.col("doc_id") % 3).cast("string"), unit("doc_id", 6), F.lit(" + "), (F.col("n_chars") % 10).cast("string"), unit("n_chars", 5))
    return rows.select("doc_id", instant_text(dates.relative_age(age, AS_OF, mode="reference"), "at"))


_AGE_UNITS = ("h", "d", "w", "mo", "y", " ago")


@add("f08_relative_age", f"""
SELECT doc_id, {instant_sql(f'''{AS_OF_SQL} - CASE doc_id % 6
  WHEN 0 THEN to_hours(n_chars % 90) WHEN 1 THEN to_days(CAST(n_chars % 90 AS INT))
  WHEN 2 THEN to_days(CAST(7 * (n_chars % 90) AS INT)) WHEN 3 THEN to_days(CAST(30 * (n_chars % 90) AS INT))
  WHEN 4 THEN to_days(CAST(365 * (n_chars % 90) AS INT)) ELSE to_days(0) END''')} AS at FROM documents""")
def _(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in _AGE_UNITS]), (F.col("doc_id") % 6 + 1).cast("int"))
    age = F.concat((F.col("n_chars") % 90).cast("string"), unit)
    return table(spark, sf, "documents").select("doc_id", instant_text(dates.relative_age(age, AS_OF), "at"))


@add("f09_format_digest_date", with_items(f"SELECT ord, {digest_date_sql('published')} AS shown FROM items"))
def _(spark, sf):
    return items(spark, sf).select("ord", dates.format_digest_date("published").alias("shown"))


@add("f10_format_date", with_items("""SELECT ord,
  CASE WHEN published LIKE '____-__-__%' THEN strftime(strptime(substr(published, 1, 10), '%Y-%m-%d'), '%b %d, %Y')
       WHEN published LIKE 'Mon, %' THEN strftime(strptime(substr(published, 6, 11), '%d %b %Y'), '%b %d, %Y')
       ELSE published END AS shown FROM items"""))
def _(spark, sf):
    return items(spark, sf).select("ord", dates.format_date("published").alias("shown"))


@add("f11_truncate_html", with_items(f"SELECT ord, {truncate_html_sql("coalesce(summary, '')")} AS short FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", text.truncate_html("summary").alias("short"))


@add("f12_truncate_text", with_items(f"""SELECT ord, CASE WHEN length(coalesce(summary, '')) <= 200
  THEN coalesce(summary, '') ELSE concat({strip_sql('substr(summary, 1, 200)')}, '...') END AS short FROM items"""))
def _(spark, sf):
    return documents(spark, sf).select("ord", text.truncate_text("summary").alias("short"))


@add("f13_relevance_digest", with_items(f"SELECT ord, {score_sql(scoring.DIGEST_PRESET)} AS relevance_score FROM items"))
def _(spark, sf):
    return scoring.with_relevance(documents(spark, sf), scoring.DIGEST_PRESET).select("ord", "relevance_score")


@add("f13_relevance_workflow", with_items(
    f"SELECT ord, {score_sql(scoring.WORKFLOW_PRESET)} AS relevance_score FROM items"))
def _(spark, sf):
    return scoring.with_relevance(documents(spark, sf)).select("ord", "relevance_score")


@add("f14_escape_template", with_items(f"SELECT ord, {template_sql('summary')} AS safe FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", text.escape_template("summary").alias("safe"))


@add("f15_escape_html", f"SELECT page_id, {escape_sql('html')} AS safe FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.escape_html("html").alias("safe"))


@add("f16_title_case", f"SELECT doc_id, {title_case_sql("concat(lang, '-', source, ' [', lang, ' NEWS]')")} AS heading FROM documents")
def _(spark, sf):
    name = F.concat("lang", F.lit("-"), "source", F.lit(" ["), "lang", F.lit(" NEWS]"))
    return table(spark, sf, "documents").select("doc_id", text.title_case(name).alias("heading"))


@add("f17_byline", with_items("""SELECT ord, CASE WHEN author IS NOT NULL AND author <> '' AND author <> 'Unknown'
  THEN author END AS byline FROM items"""))
def _(spark, sf):
    return items(spark, sf).select("ord", text.byline("author").alias("byline"))


@add("f18_content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash("text").alias("hash"))


@add("f19_html_to_text", f"SELECT page_id, {page_text_sql('html')} AS body FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.html_to_text("html").alias("body"))


@add("f20_prepare_for_summary", f"""
SELECT page_id, CASE WHEN length(t) > 8000 THEN concat(substr(t, 1, 8000), '...') ELSE t END AS prepared
FROM (SELECT page_id, {page_text_sql('html')} AS t FROM pages)""")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.prepare_for_summary("html").alias("prepared"))


@add("f21_summary_prompt", """
SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'Human: Please summarize' ELSE 'Summarize' END,
  ' the following content in about 15-30 words',
  CASE doc_id % 3 WHEN 2 THEN ':' ELSE '. Focus on the main points and key takeaways:' END,
  chr(10), repeat(' ', 12), chr(10), repeat(' ', 12), text,
  CASE doc_id % 3 WHEN 0 THEN concat(chr(10), repeat(' ', 12), chr(10), repeat(' ', 12), 'Assistant:') ELSE '' END
) AS prompt FROM documents""")
def _(spark, sf):
    model = F.when(F.col("doc_id") % 3 == 0, "anthropic.claude-v2").when(
        F.col("doc_id") % 3 == 1, "amazon.titan-text"
    ).otherwise("other")
    return table(spark, sf, "documents").select("doc_id", text.summary_prompt("text", model).alias("prompt"))


@add("f22_fallback_summary", f"""SELECT conv_id, turn, CASE WHEN length({strip_sql('text')}) < 100 THEN text
  ELSE concat(substr(text, 1, 150), '...') END AS short FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.fallback_summary("text").alias("short"))


@add("f23_safe_file_name", """SELECT page_id,
  substr(replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '..', '_'), 1, 255) AS name FROM pages""")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.safe_file_name("url").alias("name"))


@add("f24_scrub_control", with_items(
    "SELECT ord, regexp_replace(coalesce(summary, 'None'), '[\\x00-\\x1f\\x7f]', ' ', 'g') AS line FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", text.scrub_control("summary").alias("line"))


@add("f25_absolute_link", """
SELECT page_id, CASE WHEN starts_with(p, '/') THEN concat('https://www.linkedin.com', p) ELSE p END AS link
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1) ELSE url END AS p FROM pages)""")
def _(spark, sf):
    path = F.when(
        F.col("page_id") % 2 == 0, F.regexp_extract("url", "^[^:]+://[^/]*(.*)$", 1)
    ).otherwise(F.col("url"))
    return pages(spark, sf).select("page_id", urls.absolute_link(path).alias("link"))


@add("p13_valid_email", """
SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE concat(source, '.', lang, '@example.org') END AS address
FROM documents""")
def _(spark, sf):
    d = F.col("doc_id")
    name = F.concat("source", F.lit("."), "lang")
    raw = F.when(d % 5 == 3, F.concat(name, F.lit("@localhost"))).when(
        d % 5 == 1, F.concat(F.lit("  "), name, F.lit("@example.org "))
    ).otherwise(F.concat(name, F.lit("@example.org")))
    return table(spark, sf, "documents").select("doc_id", text.valid_email(raw).alias("address"))
