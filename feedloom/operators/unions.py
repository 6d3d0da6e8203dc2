"""Bag unions of item frames from different origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

ORIGINS = ("rss", "github", "youtube", "linkedin")


def union_sources(frames: dict[str, DataFrame], selected=None) -> DataFrame:
    """Union the chosen origins, tagging ``origin`` and ``source_rank``; absent fields become null.

    The order of ``frames`` is the order of the rows: ``source_rank`` first, then ``ord``.
    Origins that are not selected are never read.
    """
    chosen = [name for name in frames if selected is None or name in selected]
    tagged = [
        frames[name].withColumns({"origin": F.lit(name), "source_rank": F.lit(rank)})
        for rank, name in enumerate(chosen)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def rank_order(df: DataFrame) -> DataFrame:
    """Fold ``source_rank`` into the top bits of ``ord``: unique, and in the union's order.

    Room for eight origins and for any ``ord`` from 0 to below 2**60; anything else is an error.
    """
    rank, own = F.col("source_rank").cast("long"), F.col("ord")
    fits = F.coalesce((rank >= 0) & (rank < 8) & (own >= 0) & (own < 1 << 60), F.lit(False))
    folded = F.shiftleft(rank, 60) + own
    return df.withColumn("ord", F.when(fits, folded).otherwise(F.raise_error(F.lit("ord or source_rank out of range")).cast("long")))
