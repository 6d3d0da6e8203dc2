"""Queries for deduplication."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from feedloom.catalog.base import (
    AS_OF, AS_OF_SQL, Registry, dated_items, documents, instant_sql, instant_text, with_items,
)
from feedloom.catalog.scalars import norm_url_sql, strip_sql, words_sql
from feedloom.operators import dedup
from feedloom.operators.ranking import number_sorted

REGISTRY = Registry()
add = REGISTRY.add

DEDUP_ORDER = f"coalesce(published_ts, {AS_OF_SQL}) DESC, ord"
FINGERPRINT = (
    "md5(concat_ws(' ', CASE WHEN link <> '' THEN regexp_extract(link, '^[^:/?#]+://([^/?#]*)', 1) END, "
    f"CASE WHEN title <> '' THEN array_to_string({words_sql('title')}, ' ') END, "
    f"CASE WHEN summary <> '' THEN array_to_string(list_slice({words_sql('summary')}, 1, 100), ' ') END))"
)


def keyed_sql(source: str = "items") -> str:
    return f"keyed AS (SELECT *, {norm_url_sql('link')} AS norm_url, {FINGERPRINT} AS fp FROM {source})"


# The two-window form: first per URL, then first per fingerprint. Equal to the greedy rule on these tables
# at the scale the SQL check uses.
TWO_WINDOWS = (
    f"by_url AS (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY {DEDUP_ORDER}) AS rn_url, "
    f"first_value(ord) OVER (PARTITION BY norm_url ORDER BY {DEDUP_ORDER}) AS url_head FROM keyed WHERE link <> '')",
    f"by_fp AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY {DEDUP_ORDER}) AS rn_fp, "
    f"first_value(ord) OVER (PARTITION BY fp ORDER BY {DEDUP_ORDER}) AS fp_head FROM by_url WHERE rn_url = 1)",
)


def survivors_sql(source: str = "items") -> tuple[str, ...]:
    """CTEs up to ``survivors(ord)``."""
    kept = "survivors AS (SELECT ord FROM by_fp WHERE rn_fp = 1 UNION ALL SELECT ord FROM keyed WHERE link = '')"
    return keyed_sql(source), *TWO_WINDOWS, kept


REPORT_SQL = with_items(
    """SELECT (SELECT count(*) FROM items) AS input_count, (SELECT count(*) FROM survivors) AS output_count,
       (SELECT count(*) FROM items) - (SELECT count(*) FROM survivors) AS dropped_count""", *survivors_sql())


@add("d01_sort_for_dedup", with_items(
    f"""SELECT ord, {instant_sql(f'coalesce(published_ts, {AS_OF_SQL})')} AS at,
        row_number() OVER (ORDER BY {DEDUP_ORDER}) - 1 AS pos FROM items"""))
def _(spark, sf):
    ordered = number_sorted(dedup.sort_for_dedup(dated_items(spark, sf).select("ord", "published_ts"), AS_OF))
    return ordered.select("ord", instant_text(F.coalesce("published_ts", dedup.instant(AS_OF)), "at"), "pos")


def first_sql(key: str) -> str:
    return with_items(
        f"""SELECT ord, link FROM (SELECT ord, link, row_number() OVER (PARTITION BY {key} ORDER BY {DEDUP_ORDER}) AS rn
            FROM items WHERE link <> '') WHERE rn = 1 UNION ALL SELECT ord, link FROM items WHERE link = ''"""
    )


@add("d02_first_per_url", first_sql(strip_sql("link")))
def _(spark, sf):
    return dedup.first_per_url(dated_items(spark, sf).select("ord", "link", "published_ts"), AS_OF).select("ord", "link")


@add("d03_first_per_normalised_url", first_sql(norm_url_sql("link")))
def _(spark, sf):
    items = dated_items(spark, sf).select("ord", "link", "published_ts")
    return dedup.first_per_normalised_url(items, AS_OF).select("ord", "link")


@add("d04_fingerprint", with_items(f"SELECT ord, {FINGERPRINT} AS fp FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", dedup.fingerprint().alias("fp"))


def url_pairs(spark, sf):
    """Every linked item that is not the first of its normalised URL, beside the first."""
    linked = dated_items(spark, sf).filter("link <> ''").withColumn("url", dedup.normalise_url("link"))
    fields = ["ord", "title", "summary", "link", "published_ts"]
    first = dedup.first_per_normalised_url(linked, AS_OF).select("url", *[F.col(c).alias(f"kept_{c}") for c in fields])
    later = linked.select("url", *[F.col(c).alias(f"later_{c}") for c in fields])
    return later.join(first, "url").filter("later_ord <> kept_ord")


@add("d05_duplicate_pairs")
def _(spark, sf):
    return dedup.duplicate_pairs(url_pairs(spark, sf)).select("later_ord", "kept_ord", "is_duplicate")


@add("d06_similarity")
def _(spark, sf):
    """Both ratios that the rule asks for, of whole texts."""
    pairs = dedup.with_similarity(url_pairs(spark, sf), "later_summary", "kept_summary").withColumnRenamed("similarity", "summary_similarity")
    return dedup.with_similarity(pairs, "later_title", "kept_title").select("later_ord", "kept_ord", "similarity", "summary_similarity")


@add("d06_similar_titles")
def _(spark, sf):
    """Which titles, under one URL or not, are alike at the ratio that suffices alone, by the first item of each, and the
    other items of each title with the first."""
    return dedup.similar_titles(dated_items(spark, sf).select("ord", "title"))


# With thresholds of 1 similar means equal, which SQL can state; then the rule is a walk over the items, newest first.
ALIKE = """((lower({a}title) = lower({b}title) AND {a}title <> '')
  OR (site({a}link) = site({b}link) AND site({a}link) <> '' AND lower({a}summary) = lower({b}summary) AND {a}summary <> ''))"""


def alike_sql(a: str, b: str) -> str:
    return re.sub(r"site\((.*?)\)", r"regexp_extract(\1, '^[^:/?#]+://([^/?#]*)', 1)", ALIKE.format(a=a, b=b))


@add("d05_duplicate_pairs_exact", with_items(
    f"""SELECT l.ord AS later_ord, k.ord AS kept_ord, coalesce({alike_sql('l.', 'k.')}, FALSE) AS is_duplicate
        FROM heads l JOIN heads k ON l.norm_url = k.norm_url AND k.rn = 1 AND l.rn > 1""",
    keyed_sql(),
    f"heads AS (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY {DEDUP_ORDER}) AS rn FROM keyed WHERE link <> '')"))
def _(spark, sf):
    judged = dedup.duplicate_pairs(url_pairs(spark, sf), threshold=1.0, alone=1.0)
    return judged.select("later_ord", "kept_ord", "is_duplicate")


#: Copies stand behind all items.
COPY = 1 << 40


def with_copies(spark, sf):
    """Every item and a copy at another address: with a mark after its title, a word after its summary, or both."""
    items = dated_items(spark, sf).select("ord", "title", "summary", "link", "published_ts")
    third = F.col("ord") % 3
    copies = items.withColumns({
        "title": F.when(third != 0, F.concat("title", F.lit(" ?"))).otherwise(F.col("title")),
        "summary": F.when(third != 1, F.concat("summary", F.lit(" afterwards"))).otherwise(F.col("summary")),
        "link": F.replace("link", F.lit("/a/"), F.lit("/b/")),
    })
    return items.unionByName(copies.withColumn("ord", F.col("ord") + COPY))


COPIES = f"""copied AS (SELECT ord, title, summary, link, published_ts FROM items UNION ALL
  SELECT ord + {COPY}, CASE WHEN ord % 3 <> 0 THEN concat(title, ' ?') ELSE title END,
  CASE WHEN ord % 3 <> 1 THEN summary || ' afterwards' ELSE summary END, replace(link, '/a/', '/b/'), published_ts FROM items)"""
WALK = (
    COPIES,
    keyed_sql("copied"),
    f"""steps AS MATERIALIZED (SELECT ord, row_number() OVER (ORDER BY {DEDUP_ORDER}) AS n, link <> '' AS linked,
      hash(norm_url) AS u, hash(fp) AS f, CASE WHEN title <> '' THEN hash(lower(title)) END AS t,
      CASE WHEN summary <> '' AND link <> '' THEN hash(regexp_extract(link, '^[^:/?#]+://([^/?#]*)', 1), lower(summary)) END AS s
      FROM keyed)""",
    """walk AS (SELECT 0::BIGINT AS n, 0::BIGINT AS ord, '' AS fate, []::UBIGINT[] AS us, []::UBIGINT[] AS fs,
        []::UBIGINT[] AS ts, []::UBIGINT[] AS ss
      UNION ALL SELECT n, ord, fate, CASE WHEN fate = 'kept' AND linked THEN list_append(us, u) ELSE us END,
        CASE WHEN fate = 'kept' AND linked THEN list_append(fs, f) ELSE fs END,
        CASE WHEN fate = 'kept' AND t IS NOT NULL THEN list_append(ts, t) ELSE ts END,
        CASE WHEN fate = 'kept' AND s IS NOT NULL THEN list_append(ss, s) ELSE ss END
      FROM (SELECT steps.*, us, fs, ts, ss, CASE WHEN NOT linked THEN 'kept' WHEN list_contains(us, u) THEN 'url'
          WHEN list_contains(fs, f) AND (coalesce(list_contains(ts, t), FALSE) OR coalesce(list_contains(ss, s), FALSE))
          THEN 'content' ELSE 'kept' END AS fate FROM walk JOIN steps ON steps.n = walk.n + 1))""",
)


def walk_sql(select: str) -> str:
    return with_items(select, *WALK).replace("WITH ", "WITH RECURSIVE ", 1)


@add("d07_deduplicate_exact", walk_sql("SELECT ord FROM walk WHERE fate = 'kept'"))
def _(spark, sf):
    return dedup.deduplicate(with_copies(spark, sf), AS_OF, threshold=1.0, alone=1.0).select("ord")


@add("j06_content_duplicates_exact", walk_sql("SELECT ord FROM walk WHERE fate = 'content'"))
def _(spark, sf):
    dropped = dedup.dropped_rows(with_copies(spark, sf), AS_OF, threshold=1.0, alone=1.0)
    return dropped.filter("reason = 'content'").select("ord")


@add("d07_deduplicate", with_items("SELECT ord FROM survivors", *survivors_sql()))
def _(spark, sf):
    return dedup.deduplicate(dated_items(spark, sf), AS_OF).select("ord")


@add("d08_dedup_report", REPORT_SQL)
def _(spark, sf):
    items = dated_items(spark, sf)
    return dedup.dedup_report(items, dedup.dropped_rows(items, AS_OF, reasons=False))


@add("j06_content_duplicates", with_items(
    "SELECT ord, fp_head AS matched FROM by_fp WHERE rn_fp > 1", keyed_sql(), *TWO_WINDOWS))
def _(spark, sf):
    dropped = dedup.dropped_rows(dated_items(spark, sf), AS_OF)
    return dropped.filter("reason = 'content'").select("ord", "matched")
