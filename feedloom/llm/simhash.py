"""SimHash near-duplicates through covering locality-sensitive hashing.

Every bit of a fingerprint has a vector of ``radius + 1`` bits. For each non-zero vector v there is a mask of the bits
whose vector has an odd product with v. The vectors of at most ``radius`` differing bits don't span the space, so some v
is orthogonal to all of them: under its mask the two fingerprints are equal. No pair within the radius is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import output_schema, slices
from feedloom.llm.groups import components, whole_groups
from feedloom.session import stage

BITS, SEED = 64, 42
SHINGLE = 4
#: Fingerprints of one bucket that one task compares; larger buckets are dealt out by masks of the bits still free.
BUCKET = 1 << 14
SHINGLES_AT_ONCE = 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingles' hashes; zero for a text without words. ASCII case is ignored."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate([[0], ends[:n - 1]]).tolist()
    last = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(first[at:at + SHINGLES_AT_ONCE], last[at:at + SHINGLES_AT_ONCE])], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, *, text: str = "text", output: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text and with its fingerprint as a signed long in ``output``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                prints = [fingerprint(x, shingle) for x in part.column(text).cast(pa.binary()).to_pylist()]
                kept = {n: part.column(n) for n in part.schema.names if n not in (text, output)}
                yield pa.RecordBatch.from_pydict({**kept, output: pa.array(np.array(prints, np.uint64).view(np.int64))})

    return docs.mapInArrow(run, output_schema(docs.drop(text), **{output: "long"}))


def covering_masks(radius: int, bits: list[int] | None = None, seed: int = 7) -> list[int]:
    """Masks such that any ``radius`` of the given bits are all outside some mask. The vectors of the bits go round all
    non-zero ones in a shuffled order, so that masks are of nearly equal size."""
    bits = list(range(BITS)) if bits is None else bits
    size = (1 << (radius + 1)) - 1
    order = np.random.default_rng(seed).permutation(size) + 1
    vector = {b: int(order[k % size]) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _bucket_rows(prints: DataFrame, masks: list[int]) -> DataFrame:
    """``fp, mask, bucket`` for each fingerprint and mask."""
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for k, m in enumerate(masks)])
    return prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")


def _split(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Rows of large buckets, each dealt out by a covering of the bits its own mask leaves free.

    At most ``2 ** 16`` fingerprints can agree on both masks, as about a quarter of the bits is then left.
    """
    inner = [covering_masks(radius, [b for b in range(BITS) if not m >> b & 1], seed=11) for m in masks]
    table = F.from_json(F.lit(str([[_signed(x) for x in row] for row in inner])), "array<array<long>>")
    sub = F.transform(F.element_at(table, F.col("mask") + 1), lambda x, i: F.struct(((F.col("mask") + 1) * 1000 + i).alias("mask"), F.col("fp").bitwiseAND(x).alias("sub")))
    return rows.select("fp", "bucket", F.explode(sub).alias("k")).select("fp", F.col("k.mask").alias("mask"), F.xxhash64("bucket", "k.sub").alias("bucket"))


def _bucket_links(values: np.ndarray, bounds: np.ndarray, radius: int):
    """Links that connect all fingerprints within the radius in each bucket: pairs of positions of ``values``.

    Small buckets of equal size are compared together. In a large one links are followed breadth first: a fingerprint is
    compared with those not yet reached, so a tight group takes one pass and no list of pairs is made.
    """
    sizes = np.diff(bounds)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]).tolist():
        first, second = np.triu_indices(size, 1)
        group = bounds[:-1][sizes == size]
        for part in np.array_split(group, max(1, len(group) * len(first) >> 20)):
            a, b = part[:, None] + first, part[:, None] + second
            near = np.bitwise_count(values[a] ^ values[b]) <= radius
            yield a[near], b[near]
    for k in np.flatnonzero(sizes > 32).tolist():
        left = np.arange(bounds[k], bounds[k + 1])
        queue: list[int] = []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            found = left[near]
            if len(found):
                yield np.full(len(found), at), found
                queue += found.tolist()
                left = left[~near]


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``fp``) that connect every pair within the radius."""
    masks = covering_masks(radius)
    rows = _bucket_rows(prints, masks)
    sizes = rows.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    large = stage(sizes.where(F.col("n") > BUCKET).select("mask", "bucket"), "simhash-large")
    small = rows.join(large, ["mask", "bucket"], "left_anti")
    dealt = small.unionByName(_split(rows.join(large, ["mask", "bucket"]), masks, radius))

    def links(batches):
        for table in whole_groups(batches, ["mask", "bucket"]):
            mask, bucket = table.column("mask").to_numpy(), table.column("bucket").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])]))
            fp = table.column("fp").to_numpy()
            for a, b in _bucket_links(fp.view(np.uint64), np.append(new, len(fp)), radius):
                yield pa.RecordBatch.from_pydict({"a": fp[a], "b": fp[b]})

    return dealt.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket").mapInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", row: str | None = None, radius: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """``key, fingerprint, component_id, kept`` for every document, and the column ``row`` if one is named.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest key
    reachable, itself included. A null or empty text has the fingerprint zero and is linked like any other. Rows without
    a key take part and get their component's smallest key, null if no row has one. ``kept`` marks one row of each
    component, of those with its smallest key the one with the smallest ``row``; rows are numbered if it isn't given.

    An empty table gives an empty one; columns other than those named aren't read. Texts are read once and never shuffled.
    Documents with equal fingerprints are one node, however many they are.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    prints = stage(with_fingerprint(docs.select(F.col(key).alias("key"), number.alias("row"), F.col(text).alias("text")), shingle=shingle), "simhash")
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row"))
    distinct = stage(prints.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    groups = components(near_links(distinct.select("fp"), radius), "simhash")
    nodes = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    nodes = stage(nodes, "simhash-nodes")
    smallest = stage(nodes.groupBy("group").agg(F.min("first").alias("first")), "simhash-smallest")
    found = stage(nodes.select("fp", "group").join(smallest, "group").select("fp", "first"), "simhash-found")
    return prints.join(found, "fp").select(
        F.col("key").alias(key), *([] if row is None else [F.col("row").alias(row)]), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.key").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"),
    )
