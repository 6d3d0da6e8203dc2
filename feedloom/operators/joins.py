"""Look-ups and merges. No side is broadcast by hint: Spark broadcasts what it has measured as small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedloom.functions.text import content_hash, text_or_empty


def enrich_with_source(entries: DataFrame, sources: DataFrame, key: str = "source_key") -> DataFrame:
    """Give every entry its source's name and category; entries of unknown sources are dropped."""
    return entries.join(sources, key)


def with_video_statistics(videos: DataFrame, statistics: DataFrame, key: str = "video_id") -> DataFrame:
    """Attach view, like and comment counts; videos without details keep nulls.

    A video landed with several rows of details takes the row that is last in text order, so it stays one row. Details are
    combined before the shuffle.
    """
    counts = {c: F.coalesce(F.col(c), F.lit("0")) for c in ("views", "likes", "comments")}
    rest = [c for c in statistics.columns if c not in (key, *counts)]
    one = statistics.withColumns(counts).groupBy(key).agg(F.max(F.struct(*counts, *rest)).alias("details"))
    return videos.join(one, key, "left").select(*[F.col(c) for c in videos.columns], *[F.col(f"details.{c}").alias(c) for c in statistics.columns if c != key])


def merge_summaries(items: DataFrame, summaries: DataFrame) -> DataFrame:
    """Copy non-empty summaries onto their items by ``ord``; other items keep what they had.

    Of several summaries of an item the last in text order counts, field by field, so an item stays one row.
    """
    fields = ("ai_summary", "generated_summary")
    new = summaries.groupBy("ord").agg(*[F.max(F.nullif(F.col(f), F.lit(""))).alias(f"new_{f}") for f in fields])
    merged = {f: F.coalesce(F.col(f"new_{f}"), F.col(f)) for f in fields}
    return items.join(new, "ord", "left").withColumns(merged).drop(*[f"new_{f}" for f in fields])


def cache_key(content: str = "summary", link: str | None = None, own: str | None = None):
    """Key of a row in the summary cache: the hash of its content or, where that is blank and ``link`` is given, of its
    link. A row with neither has the key of no entry; with ``own``, a column of unique values, it has one of its own, so
    that such rows don't meet under one value in a join."""
    text, url = text_or_empty(content), text_or_empty(link) if link else F.lit("")
    nothing = F.concat(F.lit("row-"), F.col(own).cast("string")) if own else F.concat(F.lit("row-"), F.expr("uuid()"))
    return F.when(text != "", content_hash(text)).when(url != "", content_hash(url)).otherwise(nothing)


def cache_hits(items: DataFrame, cache: DataFrame, content: str = "summary", link: str | None = None) -> DataFrame:
    """Attach the cached summary, null on a miss. Blank content is looked up by ``link`` if given, else by nothing."""
    keyed = items.withColumn("hash", cache_key(content, link)).join(cache, "hash", "left")
    return keyed.withColumn("hash", F.when(~F.startswith("hash", F.lit("row-")), F.col("hash")))


def cache_misses(items: DataFrame, cache: DataFrame, content: str = "summary", link: str | None = None) -> DataFrame:
    """Rows whose content, or link, has no cached summary; those with neither have a null ``hash``."""
    keyed = items.withColumn("hash", cache_key(content, link)).join(cache, "hash", "left_anti")
    return keyed.withColumn("hash", F.when(~F.startswith("hash", F.lit("row-")), F.col("hash")))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache after writing ``fresh(hash, summary, version)``: the highest version of a hash wins."""
    both = cache.unionByName(fresh)
    latest = Window.partitionBy("hash").orderBy(F.col("version").desc(), F.col("summary"))
    return both.withColumn("rn", F.row_number().over(latest)).filter("rn = 1").drop("rn")


def count_per_source(sources: DataFrame, items: DataFrame, key: str = "source") -> DataFrame:
    """Item count of every configured source, zero included.

    Items are counted before the join, so the join sees one row per source.
    """
    counts = items.groupBy(key).agg(F.count("*").alias("items"))
    return sources.join(counts, key, "left").withColumn("items", F.coalesce("items", F.lit(0)))
