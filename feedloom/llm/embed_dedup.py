"""Embedding near-duplicates: randomly rotated binary codes with correction factors, and exact recomputation.

A unit vector x, rotated, is coded by its signs; c is the sign vector over the root of the dimension. With the stored
factor <x, c>, <y, c> / <x, c> is an unbiased estimate of <x, y> for any y, and its error beyond e * sqrt((1 - <x, c>
squared) / <x, c> squared / (dimension - 1)) is as unlikely as a normal variate beyond e. Pairs whose upper bound is
under the threshold are done; the others are computed in double precision, which alone decides.

Which pairs are estimated: signs of several rotations, cut into short keys, are buckets. Vectors within the threshold
share a key of some table with the chance ``RECALL`` or a higher one; a pair is dealt with in the first table in which
it shares one, so its link is counted once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import whole_key
from feedloom.llm.groups import components, whole_groups
from feedloom.llm.vectors import dimension, matrix, rotation, usable
from feedloom.session import stage

THRESHOLD = 0.98
#: Standard errors of the estimate within which a pair is recomputed; a miss at 5 is one in three million.
ERRORS = 5.0
#: Chance that a pair just at the threshold shares a key; closer pairs share one more surely.
RECALL = 0.99999
#: Rows of a bucket compared in one task; a larger bucket is dealt out in pairs of blocks.
BLOCK = 2048
PAIRS_AT_ONCE = 1 << 19


def key_bits(rows: int) -> int:
    """Bits of a bucket's key: three more than number the rows of a label, so that few vectors meet by chance."""
    return max(8, min(28, 3 + math.ceil(math.log2(max(2, rows)))))


def tables_for(bits: int, least: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Tables needed for that chance to be ``least``."""
    return math.ceil(math.log(1 - least) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits))


def coded(vectors: DataFrame, dim: int, bits: int, tables: int, seed: int = 5) -> DataFrame:
    """``node, label, vec, n`` with the sign code of a rotation, its factor, and the keys of all tables."""
    rounds = math.ceil(bits * tables / dim)
    turns = [rotation(dim, seed + k) for k in range(rounds)]

    def run(batches):
        powers = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            x = matrix(batch.column("vec"))
            if not len(x):
                continue
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            turned = [x @ t for t in turns]
            signs = np.concatenate([t > 0 for t in turned], axis=1)[:, :bits * tables].reshape(len(x), tables, bits)
            factor = np.abs(turned[0]).sum(axis=1) / math.sqrt(dim)
            code = np.packbits(turned[0] > 0, axis=1)
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node"), "label": batch.column("label"), "vec": batch.column("vec"), "n": batch.column("n"),
                "code": pa.array([c.tobytes() for c in code], pa.binary()), "factor": factor,
                "keys": pa.array(list((signs * powers).sum(axis=2).astype(np.int32)), pa.list_(pa.int32())),
            })

    kind = vectors.schema["vec"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"node long, label {label}, vec {kind}, n long, code binary, factor double, keys array<int>")


def bounds(code_a: np.ndarray, factor_a: np.ndarray, turned_b: np.ndarray, dim: int, errors: float = ERRORS) -> np.ndarray:
    """Upper bounds of the inner products of unit vectors a, given by signs and factors, with rotated unit vectors b.

    Signs are 1 and -1; rows of the result are a, columns b.
    """
    estimate = (code_a @ turned_b.T) / math.sqrt(dim) / factor_a[:, None]
    spread = np.sqrt(np.maximum(0, 1 - factor_a * factor_a)) / factor_a / math.sqrt(max(1, dim - 1))
    return estimate + errors * spread[:, None]


def _signs(codes: pa.ChunkedArray, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(raw, axis=1, count=dim).astype(np.float32) * 2 - 1


def near_pairs(rows: DataFrame, dim: int, tables: int, threshold: float = THRESHOLD, errors: float = ERRORS, seed: int = 5) -> DataFrame:
    """``node, links, root`` for each group of rows that share a key: the vectors linked to a representative and found in
    that group first, each with its copies, and a representative that the group's links connect it to."""
    thin = rows.select("node", "label", F.posexplode("keys").alias("table", "key"))
    shared = stage(thin.groupBy("label", "table", "key").agg(F.count("*").alias("size")).where("size > 1"), "embed-buckets")
    # a list of at most one entry for each table, so that a vector is shuffled for the buckets it shares only
    places = thin.join(shared, ["label", "table", "key"]).groupBy("node").agg(F.collect_list(F.struct("table", "key", "size")).alias("places"))
    dealt = rows.join(places, "node").select("*", F.explode("places").alias("at")).select("*", "at.table", "at.key", "at.size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    dealt = dealt.withColumn("own", own).select("*", F.explode(every).alias("p")).select(
        "label", "table", "key", "p.low", "p.high", "own", "node", "n", "vec", "code", "factor", "keys"
    )
    turn = rotation(dim, seed)
    by = ["label", "table", "key", "low", "high"]

    def run(batches):
        for group in whole_groups(batches, by, 20_000):
            yield from _compare(group, by, dim, turn, threshold, errors)

    return dealt.repartition(*by).sortWithinPartitions(*by, "own", "node").mapInArrow(run, "node long, links long, root long")


def _compare(group: pa.Table, by: list[str], dim: int, turn: np.ndarray, threshold: float, errors: float):
    x = matrix(group.column("vec"))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned, sign, factor = (x @ turn).astype(np.float32), _signs(group.column("code"), dim), group.column("factor").to_numpy()
    keys, node, n = matrix(group.column("keys"), np.int32), group.column("node").to_numpy(), group.column("n").to_numpy()
    at, own = group.column("table").to_numpy(), group.column("own").to_numpy()
    low, high = group.column("low").to_numpy(), group.column("high").to_numpy()
    new = np.zeros(len(node), bool)
    new[:1] = True
    for k in by:
        values = group.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    edges = np.append(np.flatnonzero(new), len(node))
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """Exact products of the pairs left, and the links among them."""
        first = (keys[a] == keys[b]).argmax(axis=1) == at[a]
        a, b = a[first], b[first]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        a, b = a[near], b[near]
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        while len(a):
            i, j = root[a], root[b]
            a, b, i, j = a[i != j], b[i != j], i[i != j], j[i != j]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root[:] = root[root]

    sizes = np.diff(edges)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]).tolist():
        one, two = np.triu_indices(size, 1)
        starts = edges[:-1][(sizes == size)]
        for part in np.array_split(starts, max(1, len(starts) * len(one) // PAIRS_AT_ONCE)):
            a, b = (part[:, None] + one).ravel(), (part[:, None] + two).ravel()
            apart = (low[a] == high[a]) | (own[a] != own[b])
            a, b = a[apart], b[apart]
            estimate = np.einsum("ij,ij->i", sign[a], turned[b]) / math.sqrt(dim) / factor[a]
            spread = np.sqrt(np.maximum(0, 1 - factor[a] ** 2)) / factor[a] / math.sqrt(max(1, dim - 1))
            open_ = estimate + errors * spread >= threshold
            settle(a[open_], b[open_])
    for k in np.flatnonzero(sizes > 16).tolist():
        start, end = int(edges[k]), int(edges[k + 1])
        step = max(1, PAIRS_AT_ONCE // (end - start))
        for i in range(start, end, step):
            above = bounds(sign[i:min(i + step, end)], factor[i:min(i + step, end)], turned[i:end], dim, errors) >= threshold
            a, b = np.nonzero(above)
            a, b = a + i, b + i
            keep = (b > a) & ((low[a] == high[a]) | (own[a] != own[b]))
            settle(a[keep], b[keep])
    linked = np.flatnonzero(links)
    if len(linked):
        yield pa.RecordBatch.from_pydict({"node": node[linked], "links": links[linked], "root": node[root[linked]]})


def near_duplicates(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, component_id, kept`` for every vector.

    Vectors of equal, non-null labels are linked if their cosine in double precision is at least ``threshold``. Those
    that are null, zero, of a length other than the usual, or hold a null or non-finite component link with nothing, nor do
    rows without a key. Equal
    vectors are one representative with a count, however many they are, so their links are counted, not listed. Rows
    that share a key are vectors of their own. Whole-numbered keys come back as long ones, others as they are. An empty table
    gives an empty one; other columns aren't read.
    """
    rows = embeddings.select(whole_key(embeddings, key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    dim = dimension(rows, "vec")
    good = usable(F.col("vec"), dim) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = stage(rows.withColumn("good", good), "embed-rows")
    good = rows.where("good")
    distinct = good.groupBy("label", "vec").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "embed-distinct")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = key_bits(largest)
    if dim:
        tables = tables_for(bits, threshold=threshold)
        found = near_pairs(stage(coded(distinct, dim, bits, tables), "embed-codes"), dim, tables, threshold)
    else:
        found = distinct.where("false").select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    found = stage(found, "embed-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "embed").withColumnRenamed("node", "member")
    by_node = distinct.join(links, "node", "left").join(groups, F.col("node") == F.col("member"), "left").select(
        "label", "vec", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group")
    )
    by_node = stage(by_node, "embed-nodes")
    smallest = stage(by_node.groupBy("group").agg(F.min("first_id").alias("component_id")), "embed-smallest")
    by_node = stage(by_node.join(smallest, "group").select("label", "vec", "n_links", "component_id"), "embed-results")
    joined = rows.withColumn("label", F.when(F.col("good"), F.col("label"))).join(by_node, ["label", "vec"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
