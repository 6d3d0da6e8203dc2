"""Counts. Every aggregate combines on the map side, so hot keys shuffle one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.functions.text import text_or_empty
from feedloom.operators.ranking import NO_CATEGORY, top_per_source


def _count_by(df: DataFrame, key: str, default: str) -> DataFrame:
    counted = df.groupBy(F.coalesce(key, F.lit(default)).alias(key)).agg(
        F.count("*").alias("items"), F.min("ord").alias("first_ord")
    )
    return counted.orderBy(F.col("items").desc(), "first_ord")


def count_by_source(df: DataFrame) -> DataFrame:
    """Rows per source, largest first, ties by first appearance."""
    return _count_by(df, "source", "Unknown")


def count_by_category(df: DataFrame) -> DataFrame:
    """Rows per category, largest first, ties by first appearance."""
    return _count_by(df, "category", NO_CATEGORY)


def fetch_stats(df: DataFrame, origin: str = "origin") -> DataFrame:
    """Rows per origin and in total, in one row."""
    count = lambda name: F.count_if(F.col(origin) == name).alias(f"{name}_count")
    return df.agg(count("rss"), count("github"), count("youtube"), F.count("*").alias("total_items"))


def filter_stats(df: DataFrame, kept) -> DataFrame:
    """Rows before and after a filter, in one pass over a flagged frame."""
    return df.agg(F.count("*").alias("original_count"), F.count_if(kept).alias("filtered_count"))


def batch_descriptors(df: DataFrame, size: int) -> DataFrame:
    """Start, end and row count of every batch."""
    return (
        df.groupBy("batch_index")
        .agg(
            F.min("pos").alias("batch_start"),
            (F.max("pos") + 1).alias("batch_end"),
            F.count("*").alias("item_count"),
        )
        .withColumn("batch_size", F.lit(size).cast("long"))
    )


def batch_totals(df: DataFrame) -> DataFrame:
    """Number of batches and of rows."""
    return df.agg(
        F.coalesce(F.max("batch_index") + 1, F.lit(0)).alias("num_batches"), F.count("*").alias("total_items")
    )


def summaries_per_batch(df: DataFrame) -> DataFrame:
    """Non-empty generated summaries of every batch."""
    filled = text_or_empty("generated_summary") != ""
    return df.groupBy("batch_index").agg(F.count_if(filled).alias("summary_count"), F.count("*").alias("items"))


def summary_stats(df: DataFrame) -> DataFrame:
    """Summaries and rows over all batches."""
    return summaries_per_batch(df).agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum("summary_count"), F.lit(0)).alias("summarized_count"),
    )


def channel_preview(df: DataFrame, n: int = 3) -> DataFrame:
    """Per source, null included: row count, first n titles, and how many more there are."""
    counts = df.groupBy("source").agg(F.count("*").alias("items"))
    first = (
        top_per_source(df, n)
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("first"))
        .select(F.col("source").alias("_source"), F.col("first.title").alias("titles"))
    )
    joined = counts.join(first, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("more", F.greatest(F.col("items") - n, F.lit(0)))
