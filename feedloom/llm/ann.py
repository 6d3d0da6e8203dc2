"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a string of 63 hash bits, the sides of random planes it is on; a tree is its strings in
sorted order, dealt out over tasks by ranges. A query descends to the longest prefix it shares with others. Then all
trees ascend together, one bit at a time, until the vectors that share a prefix of that depth in some tree are enough;
all of these, and no others, are candidates. How many are enough is measured: the nearest of some queries, found by
brute force, must be among their candidates. A query goes to every range that its prefix reaches into.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedloom.llm.common import whole_key
from feedloom.llm.groups import whole_groups
from feedloom.llm.vectors import dimension, matrix, rotation, usable
from feedloom.session import stage

TREES, BITS = 40, 63
#: Numbers of 0 to 63 bits that are all ones.
MASKS = np.array([(1 << bits) - 1 for bits in range(BITS + 1)], np.int64)
#: Candidates to ascend for, at least: this factor times the number of vectors to the power at which the planes of an
#: angle of 60 degrees thin out their candidates, and at least so many.
CANDIDATES, POWER, LEAST = 36, 0.6, 4000
#: Queries whose nearest are found by brute force, and the share of these that must be among the candidates.
SAMPLE, RECALL = 128, 0.95
#: Rows of a tree in one range, and the sampled rows for each range that the borders are taken from.
RANGE_ROWS, SAMPLED = 20_000, 16


def candidates_for(n: int) -> int:
    return max(LEAST, math.ceil(CANDIDATES * n ** POWER))


def _centre(vectors: DataFrame, dim: int) -> np.ndarray:
    """Mean of all vectors, through which all planes go. Tasks send sums of components."""

    def run(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = matrix(batch.column("vec"))
            if len(x):
                total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim + 1), "part": np.append(total, n)})

    parts = {r["at"]: r["part"] for r in vectors.select("vec").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()}
    return np.array([parts.get(k, 0.0) for k in range(dim)]) / max(parts.get(dim, 0.0), 1.0)


def planes(dim: int, seed: int) -> np.ndarray:
    """Normals of all trees' planes, at right angles to each other as far as the dimension allows."""
    turns = [rotation(dim, seed + k) for k in range(math.ceil(TREES * BITS / dim))]
    return np.concatenate(turns, axis=1)[:, :TREES * BITS]


def hashed(vectors: DataFrame, dim: int, seed: int = 23) -> DataFrame:
    """``node, asked, vec, strings``: the hash strings of all trees as longs, whose order is that of the bits."""
    mean, directions = _centre(vectors, dim), planes(dim, seed)

    def run(batches):
        weight = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            x = matrix(batch.column("vec"))
            for at in range(0, len(x), 1000):
                part = batch.slice(at, 1000)
                bits = ((x[at:at + 1000] - mean) @ directions > 0).reshape(-1, TREES, BITS)
                strings = np.ascontiguousarray((bits * weight).sum(axis=2))
                yield pa.RecordBatch.from_pydict({n: part.column(n) for n in ("node", "asked", "vec")} | {
                    "strings": pa.ListArray.from_arrays(pa.array(np.arange(len(strings) + 1) * TREES, pa.int32()), pa.array(strings.ravel()))
                })

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("node", "asked", "vec").mapInArrow(run, f"node long, asked boolean, vec {kind}, strings array<long>")


class Ranges(NamedTuple):
    """Each tree in sorted order, cut into ranges. Equal strings can be in several, by a tie-break of each tree's own."""

    strings: np.ndarray
    ties: np.ndarray
    #: Rows of the tree before each range.
    before: np.ndarray

    def home(self, tree: int, strings: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The range of each row."""
        low, high = self.reach(tree, strings, strings)
        for a, b in {*zip(low[low < high].tolist(), high[low < high].tolist())}:
            same = (low == a) & (high == b)
            low[same] = a + np.searchsorted(self.ties[tree, a:b], ties[same], side="right")
        return low

    def reach(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last range that can hold strings from ``low`` to ``high``."""
        return np.searchsorted(self.strings[tree], low), np.searchsorted(self.strings[tree], high, side="right")


def _ties(nodes: np.ndarray) -> np.ndarray:
    """A number for each node and tree that orders equal strings differently in every tree."""
    salt = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (nodes.astype(np.uint64)[:, None] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(1)).astype(np.int64)


def ranges_of(forest: DataFrame, count: int) -> Ranges:
    """Ranges of about ``RANGE_ROWS`` rows. The driver gets the strings of ``SAMPLED`` vectors and, for every tree, one
    border and one count a range."""
    parts = max(1, math.ceil(count / RANGE_ROWS))
    drawn = forest.where(F.pmod(F.xxhash64("node"), F.lit(count)) < SAMPLED * parts).select("node", "strings").collect() if parts > 1 else []
    if not drawn:
        return Ranges(*[np.zeros((TREES, 0), np.int64)] * 2, np.zeros((TREES, 1), np.int64))
    strings, ties = np.array([r["strings"] for r in drawn], np.int64), _ties(np.array([r["node"] for r in drawn]))
    cuts = np.arange(1, parts) * len(drawn) // parts
    order = [np.lexsort((ties[:, k], strings[:, k]))[cuts] for k in range(TREES)]
    cut = Ranges(np.array([strings[at, k] for k, at in enumerate(order)]), np.array([ties[at, k] for k, at in enumerate(order)]), None)

    def run(batches):
        n = np.zeros((TREES, parts), np.int64)
        for batch in batches:
            string, tie = matrix(batch.column("strings"), np.int64), _ties(batch.column("node").to_numpy())
            for k in range(TREES if len(string) else 0):
                n[k] += np.bincount(cut.home(k, string[:, k], tie[:, k]), minlength=parts)
        yield pa.RecordBatch.from_pydict({"part": np.flatnonzero(n), "n": n[n > 0]})

    before = np.zeros((TREES, parts + 1), np.int64)
    for r in forest.select("node", "strings").mapInArrow(run, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        before[r["part"] // parts, r["part"] % parts + 1] = r["n"]
    return cut._replace(before=np.cumsum(before, axis=1)[:, :-1])


def _ends(strings: np.ndarray, depth) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest string with the same first ``depth`` bits."""
    free = MASKS[BITS - np.asarray(depth)]
    return strings & ~free, strings | free


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of one range of a tree together, in order of their strings."""
    return rows.repartition(TREES * parts, "part").sortWithinPartitions("part", "string")


def _each_range(batches, parts: int):
    """``tree, range, table`` for whole ranges."""
    for table in whole_groups(batches, ["part"], 3 * RANGE_ROWS):
        part = table.column("part").to_numpy()
        cuts = (np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(part)]):
            if end > start:
                yield *divmod(int(part[start]), parts), table.slice(start, end - start)


def sizes(forest: DataFrame, ranges: Ranges) -> DataFrame:
    """``node, d0, d1, ...`` of every asked vector: how many others share that many bits with it, in all trees together.

    Such a run starts in one range and ends in one, and these two know how many rows of the tree are before its ends.
    """
    parts = ranges.before.shape[1]

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                string, node = matrix(part.column("strings"), np.int64), part.column("node").to_numpy()
                tie, asked = _ties(node), np.flatnonzero(part.column("asked").to_numpy(zero_copy_only=False))
                for k in range(TREES):
                    own = string[asked, k]
                    to = np.stack([r for d in range(BITS + 1) for r in ranges.reach(k, *_ends(own, d))], axis=1)
                    to.sort(axis=1)
                    row, col = np.nonzero(np.diff(to, axis=1, prepend=-1))
                    yield pa.RecordBatch.from_pydict({
                        "part": k * parts + np.concatenate([ranges.home(k, string[:, k], tie[:, k]), to[row, col]]), "string": np.concatenate([string[:, k], own[row]]),
                        "node": np.concatenate([node, node[asked][row]]), "asks": np.arange(len(node) + len(row)) >= len(node),
                    })

    def run(batches):
        for tree, at, table in _each_range(batches, parts):
            string, asks = table.column("string").to_numpy(), table.column("asks").to_numpy()
            data, mine = string[~asks], string[asks]
            if not len(mine):
                continue
            found, before = np.zeros((len(mine), BITS + 1), np.int64), ranges.before[tree, at]
            for d in range(BITS + 1):
                low, high = _ends(mine, d)
                first, last = ranges.reach(tree, low, high)
                found[:, d] = np.where(last == at, before + np.searchsorted(data, high, side="right"), 0) - np.where(first == at, before + np.searchsorted(data, low), 0)
            bounds = pa.array(np.arange(len(mine) + 1) * (BITS + 1), pa.int32())
            yield pa.RecordBatch.from_pydict({"node": table.column("node").to_numpy()[asks], "sizes": pa.ListArray.from_arrays(bounds, pa.array(found.ravel()))})

    thin = forest.select("node", "asked", "strings").mapInArrow(deal, "part long, string long, node long, asks boolean")
    found = _dealt(thin, parts).mapInArrow(run, "node long, sizes array<long>")
    return found.groupBy("node").agg(*[(F.sum(F.element_at("sizes", d + 1)) - TREES).alias(f"d{d}") for d in range(BITS + 1)])


def nearest_of_some(vectors: DataFrame, k: int) -> list:
    """``node, other``: by brute force the nearest vectors of at most ``SAMPLE`` asked ones."""
    asked = vectors.where("asked").orderBy(F.xxhash64("node")).limit(SAMPLE).select("node", "vec").collect()
    if not asked:
        return []
    ids, points = np.array([r["node"] for r in asked]), np.array([r["vec"] for r in asked], float)

    def run(batches):
        away, who = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1)
        for batch in batches:
            x, node = matrix(batch.column("vec")), batch.column("node").to_numpy()
            for at in range(0, len(x), 2000):
                part, own = x[at:at + 2000], node[at:at + 2000]
                far = (points ** 2).sum(axis=1)[:, None] + (part ** 2).sum(axis=1) - 2 * points @ part.T
                far[ids[:, None] == own] = np.inf
                away, who = np.concatenate([away, far], axis=1), np.concatenate([who, np.broadcast_to(own, far.shape)], axis=1)
                best = np.argpartition(away, k - 1, axis=1)[:, :k]
                away, who = np.take_along_axis(away, best, axis=1), np.take_along_axis(who, best, axis=1)
        real = np.isfinite(away)
        yield pa.RecordBatch.from_pydict({"node": np.repeat(ids, k)[real.ravel()], "other": who[real], "away": away[real]})

    found = vectors.select("node", "vec").mapInArrow(run, "node long, other long, away double")
    place = F.row_number().over(Window.partitionBy("node").orderBy("away", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("node", "other").collect()


def candidates_needed(vectors: DataFrame, forest: DataFrame, total: DataFrame, k: int) -> int:
    """Candidates to ascend for so that the share ``RECALL`` of the nearest of some queries is among them."""
    pairs = nearest_of_some(vectors, k)
    if not pairs:
        return 0
    ids = vectors.sparkSession.createDataFrame([(n,) for n in {n for r in pairs for n in r}], "node long")
    strings = {r["node"]: np.array(r["strings"]) for r in forest.join(F.broadcast(ids), "node").select("node", "strings").collect()}
    counts = {r["node"]: [*r[1:], 0] for r in total.join(F.broadcast(ids), "node").select("node", *[f"d{d}" for d in range(BITS + 1)]).collect()}
    # A pair that shares d bits in some tree is found unless d + 1 bits, or more, give candidates enough.
    shared = ((q, BITS - int((strings[q] ^ strings[o]).min()).bit_length()) for q, o in pairs)
    need = sorted(counts[q][d + 1] + 1 for q, d in shared)
    return need[math.ceil(RECALL * len(need)) - 1]


def depths(total: DataFrame, wanted: int) -> DataFrame:
    """``node, depth`` of every asked vector: the greatest depth at which all trees together have ``wanted`` others."""
    depth = F.coalesce(*[F.when(F.col(f"d{d}") >= wanted, F.lit(d)) for d in range(BITS, 0, -1)], F.lit(0))
    return total.select("node", depth.alias("depth"))


def short_lists(forest: DataFrame, found: DataFrame, ranges: Ranges, k: int) -> DataFrame:
    """``node, other``: of each asked vector's candidates all that can be among its ``k`` nearest or be itself.

    A vector travels with every tree as whole numbers of 16 bits and their scale, half its size. A candidate stays if its
    distance less the rounding error isn't above the ``k + 1``-th smallest distance with its error.
    """
    parts = ranges.before.shape[1]

    def small(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            for at in range(0, len(x), 2000):
                part = batch.slice(at, 2000)
                scale = np.maximum(np.abs(x[at:at + 2000]).max(axis=1), 1e-300) / 32767
                codes = np.array([c.tobytes() for c in np.rint(x[at:at + 2000] / scale[:, None]).astype(np.int16)], object)
                string, node, depth = matrix(part.column("strings"), np.int64), part.column("node").to_numpy(), part.column("depth").to_numpy().astype(np.int64)
                tie, asked = _ties(node), np.flatnonzero(depth >= 0)
                for tree in range(TREES):
                    first, last = ranges.reach(tree, *_ends(string[asked, tree], depth[asked]))
                    times = last - first + 1
                    row = np.concatenate([np.arange(len(node)), np.repeat(asked, times)])
                    to = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
                    yield pa.RecordBatch.from_pydict({
                        "part": tree * parts + np.concatenate([ranges.home(tree, string[:, tree], tie[:, tree]), to]), "string": string[row, tree], "node": node[row],
                        "depth": np.where(np.arange(len(row)) < len(node), -1, depth[row]).astype(np.int32), "code": pa.array(codes[row], pa.binary()), "scale": scale[row],
                    })

    rows = forest.join(found, "node", "left").withColumn("depth", F.coalesce("depth", F.lit(-1))).drop("asked")
    rows = rows.mapInArrow(small, "part long, string long, node long, depth int, code binary, scale double")

    def run(batches):
        for _, _, table in _each_range(batches, parts):
            string, node, scale = (table.column(c).to_numpy() for c in ("string", "node", "scale"))
            depth = table.column("depth").to_numpy().astype(np.int64)
            data, mine = np.flatnonzero(depth < 0), np.flatnonzero(depth >= 0)
            if not len(mine) or not len(data):
                continue
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int16).reshape(len(node), -1)
            x, others, error = code[data] * scale[data, None], node[data], 0.51 * math.sqrt(code.shape[1]) * scale
            low, high = _ends(string[mine], depth[mine])
            lows, highs = np.searchsorted(string[data], low), np.searchsorted(string[data], high, side="right")
            one, two, near, far = [], [], [], []
            for q, a, b in zip(mine.tolist(), lows.tolist(), highs.tolist()):
                away = x[a:b] - code[q] * scale[q]
                away = np.sqrt(np.einsum("ij,ij->i", away, away))
                slack = error[data[a:b]] + error[q] + 1e-12 * away
                most = away + slack
                kept = np.flatnonzero(away - slack <= np.partition(most, k)[k]) if len(away) > k + 1 else np.arange(len(away))
                one.append(np.full(len(kept), node[q]))
                two.append(others[a:b][kept])
                near.append((away - slack)[kept])
                far.append(most[kept])
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(one), "other": np.concatenate(two), "least": np.concatenate(near), "most": np.concatenate(far)})

    pairs = _dealt(rows, parts).mapInArrow(run, "node long, other long, least double, most double")
    pairs = pairs.groupBy("node", "other").agg(F.min("least").alias("least"), F.min("most").alias("most"))
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("most", "other")))
    bar = F.max(F.when(F.col("place") <= k + 1, F.col("most"))).over(Window.partitionBy("node"))
    return pairs.withColumn("bar", bar).where(F.col("least") <= F.col("bar")).select("node", "other")


def search(embeddings: DataFrame, is_query, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", candidates: int | None = None) -> DataFrame:
    """``query_id, rank, <key>, score``: the ``k`` nearest rows found for each row that ``is_query`` holds for, by
    Euclidean distance in double precision, ties to the smaller key, a row itself left out.

    Vectors that are null, zero, of a length other than the usual, or hold a null or non-finite component take no part,
    nor do rows without a key. Equal vectors are one node of the forest; as only the ``k + 1`` smallest of its keys can
    be among the nearest, no other is kept with it. Repeated query rows are answered each, and rows that share a key are
    one key. Without queries or candidates the result is empty; other columns aren't read.
    """
    rows = embeddings.select(whole_key(embeddings, key).alias("id"), F.col(vector).alias("vec"), is_query.alias("is_query"))
    dim = dimension(rows, "vec") or 1
    rows = rows.where(usable(F.col("vec"), dim) & F.col("id").isNotNull())
    smallest = Window.partitionBy("vec").orderBy("id")
    ids = rows.select("id", "vec").withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    nodes = ids.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    asked = stage(rows.where("is_query").select(F.col("id").alias("query_id"), "vec").join(nodes.select("node", "vec"), "vec").select("query_id", "node"), "ann-queries")
    flags = asked.select("node").distinct().withColumn("asked", F.lit(True))
    vectors = stage(nodes.select("node", "vec").join(flags, "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "ann-vectors")
    count = vectors.count()
    forest = stage(hashed(vectors, dim), "ann-forest")
    ranges = ranges_of(forest, count)
    total = stage(sizes(forest, ranges), "ann-sizes")
    wanted = candidates or max(candidates_for(count), candidates_needed(vectors, forest, total, k))
    pairs = stage(short_lists(forest, depths(total, wanted), ranges, k), "ann-pairs")
    near = pairs.join(nodes.select(F.col("node").alias("other"), F.col("vec").alias("b"), "ids"), "other").join(nodes.select("node", F.col("vec").alias("a")), "node")
    squares = F.aggregate(F.zip_with("a", "b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    near = near.select("node", F.sqrt(squares).alias("score"), F.explode("ids").alias("id"))
    by_node = Window.partitionBy("node").orderBy("score", "id")
    near = stage(near.withColumn("place", F.row_number().over(by_node)).where(F.col("place") <= k + 1).select("node", "score", "id"), "ann-nearest")
    by_query = Window.partitionBy("query_id").orderBy("score", "id")
    result = asked.join(near, "node").where("id <> query_id").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
