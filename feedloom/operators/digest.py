"""Digests: a bounded set of rows per section, rendered and joined into one document.

Each digest reads its input once. Every row is tagged with the sections it belongs to, and one ranked
window with a group limit keeps the rows a section can show, so what meets in the last task is bounded by
sections times rows per section, whatever the size of the input. Texts are shortened before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.clock import instant
from feedloom.functions.dates import format_digest_date, long_date
from feedloom.functions.scoring import COMPETITORS, DIGEST_PRESET, contains_any, score_lowered, with_lowered
from feedloom.functions.text import (
    byline, clean_html, escape_html, escape_template, text_or_empty, title_case, truncate_html,
)
from feedloom.operators.filters import RELEVANT
from feedloom.operators.ranking import category_or_default, top_per_group

GENERATOR = "feedloom"


def _recency(lexical: bool) -> Column:
    return F.coalesce("published", F.lit("")) if lexical else F.col("published_ts")


def ordered_concat(df: DataFrame, by: list[str], order: list[str], text: str, separator: str = "") -> DataFrame:
    """Texts of each group joined in order. For bounded groups: a group's text is one string."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    out = df.groupBy(*by).agg(ordered.alias("_rows"))
    return out.withColumn(text, F.array_join(F.col("_rows._text"), separator)).drop("_rows")


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- HTML --------------------------------------------------------------------------------------------


def digest_rows(items: DataFrame, n: int = 10, lexical: bool = False) -> DataFrame:
    """Rows of the HTML digest: newest n of every category, with the category's first position.

    ``summary`` is already cleaned and cut, all texts have template delimiters neutralised.
    """
    fields = ("title", "link", "published", "source", "author")
    shown = items.select(
        "ord",
        "published_ts",
        *[escape_template(text_or_empty(f)).alias(f) for f in fields],
        escape_template(category_or_default()).alias("category"),
        truncate_html(clean_html(escape_template(text_or_empty("summary")))).alias("summary"),
    )
    # A category's first row tells where the category stands; it travels with the ranked rows.
    tagged = shown.withColumn("role", F.explode(F.array(F.lit("item"), F.lit("first"))))
    first = F.when(F.col("role") == "first", F.col("ord"))
    newest = F.when(F.col("role") == "item", _recency(lexical))
    ranked = top_per_group(
        tagged, ["category", "role"], [first.asc(), newest.desc_nulls_last(), F.col("ord").asc()], n
    ).filter((F.col("role") == "item") | (F.col("rn") == 1))
    # The ranked rows are few by now; the marker hands its position to its category and goes.
    position = F.min(F.when(F.col("role") == "first", F.col("ord"))).over(Window.partitionBy("category"))
    return ranked.withColumn("first_ord", position).filter(F.col("role") == "item").drop("role")


def html_item(row_byline: Column) -> Column:
    """Markup of one item; only the summary keeps its own markup."""
    safe = lambda c: escape_html(F.col(c))
    return _line(
        '<div class="content-item"><div class="source-label">', safe("source"), "</div>",
        '<div class="item-title"><a href="', safe("link"), '" target="_blank">', safe("title"), "</a></div>",
        '<div class="item-meta">Published: ', escape_html(format_digest_date("published")),
        F.coalesce(F.concat(F.lit(" | By: "), escape_html(row_byline)), F.lit("")), "</div>",
        F.when(F.col("summary") != "", _line('<div class="item-summary">', F.col("summary"), "</div>")).otherwise(""),
        "</div>\n",
    )


def html_digest(
    items: DataFrame, as_of, n: int = 10, lexical: bool = False, generator: str = GENERATOR,
    unsubscribe: str = "#", preferences: str = "#",
) -> DataFrame:
    """One row, ``digest``: HTML with a section per category in order of first appearance."""
    rows = digest_rows(items, n, lexical).withColumn("text", html_item(byline("author")))
    sections = ordered_concat(rows, ["category", "first_ord"], ["rn"], "text").withColumn(
        "text",
        _line(
            '<div class="category-section"><div class="category-header">', escape_html(title_case("category")),
            "</div>\n", F.col("text"), "</div>\n",
        ),
    )
    head = _line(
        '<html><body>\n<div class="header"><h1>Your Daily Content Digest</h1><div class="date">',
        long_date(instant(as_of)), "</div></div>\n",
    )
    foot = (
        f'<div class="footer"><p>This digest was generated by {generator}.</p>'
        f'<p><a href="{unsubscribe}">Unsubscribe</a> | <a href="{preferences}">Update Preferences</a></p></div>\n'
        "</body></html>"
    )
    return ordered_concat(sections, [], ["first_ord"], "text").select(
        _line(head, F.coalesce("text", F.lit("")), foot).alias("digest")
    )


# --- plain text --------------------------------------------------------------------------------------


def text_digest_rows(items: DataFrame, n: int = 10, lexical: bool = False) -> DataFrame:
    """Rows of the text digest with ``section``, ``category``, rank ``rn`` and ``score``.

    Highlights and competitor rows are the n highest scores; general rows the newest n // 2 of every
    category. Rows of section ``first`` only mark where a general category first appears.
    """
    scored = with_lowered(items).select(
        "ord", "published_ts", "title", "source", "published", "author", "link",
        category_or_default().alias("category"),
        score_lowered(F.col("title_lc"), F.col("summary_lc"), DIGEST_PRESET).alias("score"),
        contains_any(F.concat_ws(" ", "title_lc", "summary_lc"), COMPETITORS.phrases).alias("competitor"),
    )
    high = F.col("score") >= RELEVANT
    sections = F.array_compact(
        F.array(
            F.when(high, "highlight"),
            F.when(F.col("competitor"), "competitor"),
            F.when(~high, "general"),
            F.when(~high, "first"),
        )
    )
    tagged = scored.withColumn("section", F.explode(sections))
    by_category = F.col("section").isin("general", "first")
    tagged = tagged.withColumns(
        {
            "category": F.when(by_category, F.col("category")).otherwise(""),
            "_score": F.when(~by_category, F.col("score")),
            "_time": F.when(F.col("section") == "general", _recency(lexical)),
        }
    )
    order = [F.col("_score").desc(), F.col("_time").desc_nulls_last(), F.col("ord").asc()]
    ranked = top_per_group(tagged, ["section", "category"], order, n)
    limit = F.when(F.col("section") == "general", n // 2).when(F.col("section") == "first", 1).otherwise(n)
    return ranked.filter(F.col("rn") <= limit).drop("_score", "_time", "competitor")


def _text_item() -> Column:
    shown = lambda c: text_or_empty(c)
    detailed = F.col("section").isin("highlight", "competitor")
    score = F.when(
        F.col("section") == "highlight", _line(" [Relevance: ", F.col("score").cast("string"), "]")
    ).otherwise("")
    by = F.coalesce(_line("  By: ", byline("author"), "\n"), F.lit(""))
    details = F.when(
        detailed, _line("  Published: ", format_digest_date(shown("published")), "\n", by)
    ).otherwise("")
    return _line(
        "* ", shown("title"), score, "\n  Source: ", shown("source"), "\n", details, "  Link: ", shown("link"), "\n\n"
    )


def text_digest(
    items: DataFrame, as_of, n: int = 10, lexical: bool = False, generator: str = GENERATOR
) -> DataFrame:
    """One row, ``digest``: highlights, competitor news and general news as plain text."""
    ranked = text_digest_rows(items, n, lexical)
    shown = ranked.withColumn("text", F.when(F.col("section") != "first", _text_item()))
    # General categories follow their first appearance; the marker row carries it and has no text.
    shown = shown.withColumns(
        {
            "section": F.when(F.col("section") == "first", "general").otherwise(F.col("section")),
            "first_ord": F.when(F.col("section") == "first", F.col("ord")),
        }
    )
    rows = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("rn", "text"))))
    blocks = shown.groupBy("section", "category").agg(
        F.coalesce(F.min("first_ord"), F.lit(0)).alias("first_ord"), rows.alias("rows")
    )
    body = F.array_join(F.col("rows.text"), "")
    general = F.col("section") == "general"
    blocks = blocks.withColumn(
        "text", F.when(general, _line(F.upper("category"), "\n", body, "\n")).otherwise(body)
    )
    # Section headings.
    headings = {
        "highlight": (1, "AMAZON Q & CODING ASSISTANT HIGHLIGHTS"),
        "competitor": (2, "COMPETITIVE AWARENESS"),
        "general": (3, "GENERAL INDUSTRY NEWS"),
    }
    place, heading = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (number, text) in headings.items():
        place = F.when(F.col("section") == name, number).otherwise(place)
        heading = F.when(F.col("section") == name, text).otherwise(heading)
    sections = ordered_concat(blocks, ["section"], ["first_ord"], "text").select(
        place.alias("place"),
        _line(heading, "\n" + "-" * 40 + "\n", F.col("text"), F.when(general, "").otherwise("\n")).alias("text"),
    )
    head = _line("YOUR DAILY CONTENT DIGEST\n", long_date(instant(as_of)), "\n" + "=" * 60 + "\n\n")
    foot = "=" * 60 + f"\nThis digest was generated by {generator}."
    return ordered_concat(sections, [], ["place"], "text").select(
        _line(head, F.coalesce("text", F.lit("")), foot).alias("digest")
    )
