"""Bring rows of equal keys together for numpy code, many small groups at once, and connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.session import stage

BATCH_ROWS = 50_000


def whole_groups(batches, keys: list[str], least_rows: int = BATCH_ROWS):
    """Arrow tables that each hold whole groups, from batches sorted by ``keys``.

    A table is passed on once it has ``least_rows`` rows before its last group, so memory is bounded by that and the
    largest group.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(starts(table, keys))[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = table.num_rows - cut
        least_rows = max(least_rows, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(table: pa.Table, keys: list[str]):
    """For each row whether its key differs from the row before; the first row starts a group."""
    import numpy as np

    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _checksum(links: DataFrame):
    """Equal for equal sets of links; for different ones with a chance of one in 2 ** 64."""
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges`` (``a, b``, numbers), for every node of an edge.

    Alternating large-star and small-star steps over staged tables: each node sends its larger, then its smaller
    neighbours to the smallest one. Links only ever move towards a component's smallest node, whose many neighbours are
    never gathered: a step needs but the minimum of a node's neighbours, which combines before the shuffle, joined back
    to the links. The number of steps grows with the logarithm of the longest path.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large-min")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), f"{name}-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-min")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        small = stage(small.where("u <> v").distinct(), f"{name}-small")
        done = _checksum(small) == _checksum(links)
        links = small
        if done:
            break
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
