"""Sorts, top-k per group and batch numbers.

``row_number() <= k`` is planned as a group limit before the shuffle, so a group holding a third of
the rows still sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.schema import newest_first
from feedloom.session import stage

NO_CATEGORY = "uncategorized"


def category_or_default() -> Column:
    return F.coalesce("category", F.lit(NO_CATEGORY))


def sort_newest(df: DataFrame, lexical: bool = False) -> DataFrame:
    """Newest first, ties in input order."""
    return df.orderBy(*newest_first(lexical))


def sort_relevant(df: DataFrame) -> DataFrame:
    """Highest score first, ties in input order."""
    return df.orderBy(F.col("relevance_score").desc(), F.col("ord"))


def top_relevant(df: DataFrame, n: int) -> DataFrame:
    """The n highest scores, planned as one bounded heap per task."""
    return sort_relevant(df).limit(n)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First n rows of the run with title, source and link."""
    return df.orderBy("ord").limit(n).select("ord", "title", "source", "link")


def remaining(df: DataFrame, n: int = 10) -> DataFrame:
    """How many rows the preview leaves out."""
    return df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First n rows of every group in the given order, with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_per_category(df: DataFrame, n: int = 10, lexical: bool = False) -> DataFrame:
    """Newest n rows of every category."""
    df = df.withColumn("category", category_or_default())
    return top_per_group(df, ["category"], newest_first(lexical), n)


def top_half_per_category(df: DataFrame, n: int = 10, lexical: bool = False) -> DataFrame:
    """Newest n // 2 rows of every category."""
    return top_per_category(df, n // 2, lexical)


def top_per_source(df: DataFrame, n: int = 3) -> DataFrame:
    """First n rows of every source in input order."""
    return top_per_group(df, ["source"], [F.col("ord").asc()], n)


def organise_by_category(df: DataFrame, lexical: bool = False) -> DataFrame:
    """All rows, categories in order of first appearance and newest first inside each.

    One range-partitioned sort: unlike a rank window it can split a hot category over many tasks.
    """
    df = df.withColumn("category", category_or_default())
    return (
        df.join(category_order(df), "category")
        .orderBy("first_ord", *newest_first(lexical))
        .drop("first_ord")
    )


def category_order(df: DataFrame) -> DataFrame:
    """First position of every category, combined before the shuffle."""
    return df.groupBy(category_or_default().alias("category")).agg(F.min("ord").alias("first_ord"))


def dense_positions(df: DataFrame, order: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Add contiguous positions from 0 in the given order (default ``ord``), without a global window.

    The rows are range-sorted into a stage table that keeps each row's partition and place; only the
    per-partition counts, one row per partition, meet in one task.
    """
    order = order or ["ord"]
    return number_sorted(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def number_sorted(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """Add contiguous positions from 0 to rows that are already sorted, such as the result of ``orderBy``."""
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed = stage(placed, "positions")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")  # a row a partition, however many rows there are
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )


def assign_batches(df: DataFrame, size: int = 10, dense: bool = False) -> DataFrame:
    """Add ``pos`` and ``batch_index``: contiguous chunks of ``size`` rows in input order.

    ``dense`` says that ``ord`` already counts 0, 1, 2, …; then nothing is sorted or staged.
    """
    df = df.withColumn("pos", F.col("ord")) if dense else dense_positions(df)
    return df.withColumn("batch_index", F.floor(F.col("pos") / size).cast("long"))


def assign_sub_batches(batched: DataFrame, size: int = 10, sub_size: int = 3) -> DataFrame:
    """Add ``sub_batch``: chunks of ``sub_size`` rows that start anew with every batch."""
    per_batch = -(-size // sub_size)
    within = F.floor(F.pmod(F.col("pos"), F.lit(size)) / sub_size)
    return batched.withColumn("sub_batch", (F.col("batch_index") * per_batch + within).cast("long"))
