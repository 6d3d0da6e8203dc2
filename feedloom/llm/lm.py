"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised to powers of two, and an n-gram of level q is in the filter together with each of the
numbers 1 to q. Probing with 1, 2, 3 and so on until an answer is no gives the level back, never too low and rarely too
high. The filter is built in blocks, each from the n-grams of one hash range, so it is made by many tasks, and n-grams
are shuffled only after each task has counted its own.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import fold, output_schema, slices
from feedloom.session import stage

#: The end of a text, also what stands before its first word. White space can't be a word.
END = b"\n"
SMOOTHING = 0.1
BITS_PER_ENTRY, HASHES = 8, 5
#: Words whose exact counts every task gets: at most so many, none longer than so many bytes. The others are joined.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
#: Bytes of pair filter, and of word filter, broadcast at once. A larger word filter is probed in several passes over the texts.
SHARD_BYTES, WORD_SHARD_BYTES = 256 << 20, 256 << 20
#: Keys are sent to the parts of a larger pair filter: bytes of filter that a task holds, and bytes of keys for each task.
PROBED_BYTES, TASK_BYTES = 64 << 20, 256 << 20
#: Pair counts that a task holds before it passes them on, and bytes of counts for each block.
FLUSH, BLOCK_BYTES = 4 << 20, 16 << 20
CACHE_WORDS = 250_000
#: Bytes of text worked on at once.
SLICE_BYTES = 2 << 20
MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
BLOCKS_SCHEMA = "n int, bucket int, entries long, size long, bits binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Numbers of words in order of appearance, with the hash of each."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.names: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names) + len(self.new)
        self.new.append(word)
        return number

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        import xxhash

        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w) for w in self.new], np.uint64)])
            self.names += self.new
            self.new = []
        return numbers


def tokens(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, ASCII upper case lowered, each text followed by ``END``; and where each text begins."""
    flat, begins = [], []
    for text in texts:
        begins.append(len(flat))
        flat += (text or b"").lower().split()
        flat.append(END)
    return flat, np.array(begins, np.int64)


def _pair_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it. A text's first word follows ``END``, the last token of the text
    before it or, for the first text, of the last."""
    before = np.roll(hashes, 1)
    return _mixed(before * MIX[2] + hashes)


def _count_kind(n: int):
    """Words come with the counts of the whole corpus, pairs with those of one task's few million tokens."""
    return np.uint64 if n == 1 else np.uint32


def _blob_rows(n: int, keys: np.ndarray, counts: np.ndarray, bits: int):
    """Rows of sorted keys and their counts, one for each bucket, the first ``bits`` bits of a key."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = [0, *cuts.tolist(), len(keys)]
    spans = [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]
    return pa.RecordBatch.from_pydict({
        "n": pa.array([n] * len(spans), pa.int32()), "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
        "counts": pa.array([counts[a:b].astype(_count_kind(n)).tobytes() for a, b in spans], pa.binary()),
    })


BLOB_SCHEMA = "n int, bucket int, keys binary, counts binary"


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, count`` over all tokens; each task counts its own words first."""

    def run(batches):
        words, counts = _Words(), np.zeros(0, np.int64)

        def rows():
            for at in range(0, len(counts), 50_000):
                yield pa.RecordBatch.from_pydict({"word": pa.array(words.names[at:at + 50_000], pa.binary()), "count": pa.array(counts[at:at + 50_000])})

        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                numbers = words.numbers(tokens(part.column(text).cast(pa.binary()).to_pylist())[0])
                more = np.bincount(numbers, minlength=len(words.names))
                more[:len(counts)] += counts
                counts = more
                if len(counts) > CACHE_WORDS:
                    yield from rows()
                    words, counts = _Words(), np.zeros(0, np.int64)
        yield from rows()

    return texts.select(text).mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _pair_blobs(texts: DataFrame, bits: int, text: str) -> DataFrame:
    def run(batches):
        words, held, total = _Words(), [], 0

        def rows():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _blob_rows(2, keys, counts, bits)

        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                flat, _ = tokens(part.column(text).cast(pa.binary()).to_pylist())
                numbers = words.numbers(flat)
                held.append(_pair_keys(words.hashes[numbers]))
                total += len(flat)
                if total > FLUSH:
                    yield rows()
                    held, total = [], 0
                if len(words) > CACHE_WORDS:
                    words = _Words()
        if held:
            yield rows()

    return texts.select(text).mapInArrow(run, BLOB_SCHEMA)


def _word_blobs(vocabulary: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        import xxhash

        for batch in batches:
            keys = _mixed(np.array([xxhash.xxh64_intdigest(w) for w in batch.column("word").to_pylist()], np.uint64))
            order = np.argsort(keys)
            if len(keys):
                yield _blob_rows(1, keys[order], batch.column("count").to_numpy()[order], bits)

    return vocabulary.mapInArrow(run, BLOB_SCHEMA)


def _positions(keys: np.ndarray, level: int, size):
    """Bit positions of the keys at a level, one array for each hash."""
    h = _mixed(keys + np.uint64(level * int(MIX[3]) % (1 << 64)))
    step = _mixed(h ^ MIX[2]) | np.uint64(1)
    for _ in range(HASHES):
        yield ((h >> np.uint64(32)) * size) >> np.uint64(32)
        h = h + step


def _block(table: pa.Table, bits_per_entry: float) -> pa.Table:
    """The filter block of one bucket: counts of equal keys are added, quantised, and their levels entered."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
    kind = _count_kind(table.column("n")[0].as_py())
    counts = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    level = np.frexp(counts)[1]
    entries = int(level.sum())
    size = max(64, math.ceil(entries * bits_per_entry / 64) * 64)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max()) + 1):
        for at in _positions(keys[level >= q], q, np.uint64(size)):
            bits[at] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({
        "n": pa.array([table.column("n")[0].as_py()], pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        "entries": pa.array([entries]), "size": pa.array([size]), "bits": pa.array([packed], pa.binary()),
    })


class Filter(NamedTuple):
    """Blocks of some buckets in one array of bytes. ``first`` is the first bucket held, ``count`` how many."""

    key_bits: int
    first: int
    count: int
    starts: np.ndarray
    sizes: np.ndarray
    data: np.ndarray


def gather(blocks: DataFrame, n: int, key_bits: int, first: int, count: int) -> Filter:
    """The blocks of a range of buckets as one filter. The caller bounds their size."""
    own = blocks.where((F.col("n") == n) & F.col("bucket").between(first, first + count - 1))
    sizes, starts, total = np.zeros(count, np.uint64), np.zeros(count, np.int64), 0
    for r in own.select("bucket", "size").collect():
        sizes[r.bucket - first], starts[r.bucket - first] = r.size, total
        total += r.size
    data = np.zeros(max(1, total // 8), np.uint8)
    for r in own.select("bucket", "bits").toLocalIterator():
        at = starts[r.bucket - first] // 8
        data[at:at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return Filter(key_bits, first, count, starts, sizes, data)


def levels(held, keys: np.ndarray) -> np.ndarray:
    """Quantised counts of the keys, 0 for unknown ones, by probing until an answer is no."""
    key_bits, first, count, starts, sizes, data = held
    bucket = (keys >> np.uint64(64 - key_bits)).astype(np.int64) - first
    level, live, q = np.zeros(len(keys), np.int64), np.flatnonzero((bucket >= 0) & (bucket < count)), 1
    live = live[sizes[bucket[live]] > 0]
    while len(live):
        size, start = sizes[bucket[live]], starts[bucket[live]]
        member = np.ones(len(live), bool)
        for at in _positions(keys[live], q, size):
            at = at.astype(np.int64) + start
            member &= (data[at >> 3] >> (at & 7)) & 1 == 1
        live = live[member]
        level[live] = q
        q += 1
    return level


def estimate(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for none."""
    return np.where(level > 0, (3.0 * np.exp2(level - 1.0) - 1) / 2, 0.0)


class Model(NamedTuple):
    """What scoring needs: totals, the vocabulary, and the filter's blocks."""

    train_tokens: int
    train_words: int
    key_bits: int
    vocabulary: DataFrame
    blocks: DataFrame


def fit(texts: DataFrame, *, text: str = "text", bits_per_entry: int = BITS_PER_ENTRY) -> Model:
    """Counts all words and pairs of ``texts`` and builds the filter.

    The number of buckets grows with the tokens, so that a block is made from about ``BLOCK_BYTES`` of counts.
    """
    vocabulary = stage(word_counts(texts, text), "lm-words")
    total = vocabulary.agg(F.sum("count").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    key_bits = max(8, math.ceil(math.log2(max(1, n * 9 / BLOCK_BYTES))))

    def block(table: pa.Table) -> pa.Table:
        return _block(table, bits_per_entry)

    blobs = _word_blobs(vocabulary, key_bits).unionByName(_pair_blobs(texts, key_bits, text))
    return Model(n, v, key_bits, vocabulary, stage(blobs.groupBy("n", "bucket").applyInArrow(block, BLOCKS_SCHEMA), "lm-blocks"))


def _head(vocabulary: DataFrame) -> dict[bytes, int]:
    """Exact counts of the most frequent words, at most ``HEAD_WORDS``. A cut between classes of counts, a sixteenth of a
    power of two wide, is found from the number of words in each class."""
    short = vocabulary.where(F.octet_length("word") <= HEAD_BYTES).withColumn("class", F.floor(F.log2("count") * 16))
    left, least = HEAD_WORDS, None
    for r in sorted(short.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["class"]
    return {} if least is None else {bytes(r.word): r["count"] for r in short.where(F.col("class") >= least).select("word", "count").collect()}


def _shards(blocks: DataFrame, key_bits: int, n: int, most: int) -> list[tuple[int, int]]:
    """Ranges of buckets whose blocks for words (``n`` 1) or pairs (2) together stay within ``most`` bytes."""
    whole = blocks.where(F.col("n") == n).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.coalesce(F.max("size"), F.lit(0)).alias("m")).first()
    buckets = 1 << key_bits
    # no bucket holds more than the largest, so this many of them stay within the bound
    each = buckets if whole.s <= most * 8 else max(1, most * 8 // whole.m)
    return [(at, min(each, buckets - at)) for at in range(0, buckets, each)]


def _with_levels(rows: DataFrame, text: str, shared) -> DataFrame:
    """``rows`` with ``levels``, a byte for each token: that of its word where this shard of the word filter has its bucket,
    else what it was."""

    def run(batches):
        words, known = _Words(), np.empty(0, np.uint8)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                if len(words.names) > CACHE_WORDS:
                    words, known = _Words(), np.empty(0, np.uint8)
                flat, begins = tokens(part.column(text).cast(pa.binary()).to_pylist())
                numbers = words.numbers(flat)
                known = np.concatenate([known, levels(shared.value, _mixed(words.hashes[len(known):])).astype(np.uint8)])
                found, ends = known[numbers], np.append(begins, len(flat))
                if "levels" in part.schema.names:
                    found = np.maximum(found, np.frombuffer(b"".join(part.column("levels").to_pylist()), np.uint8))
                made = [found[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in part.schema.names if c != "levels"}, "levels": pa.array(made, pa.binary())})

    return rows.mapInArrow(run, output_schema(rows, levels="binary"))


#: What is known of a document before its pairs are.
BASE = {
    "held_out": "boolean", "n_tokens": "long", "head_known": "long", "head_log": "double", "tail_words": "array<binary>", "tail_times": "array<int>",
}
#: Pairs of a slice of texts: where each text begins, the place of each token's pair among the different ones, the levels of
#: both words of these, and their keys for each part of the filter.
PAIRS = "begins array<int>, places binary, history binary, own binary, n_pairs long, parts array<struct<part: int, start: int, keys: binary>>"


def _log_p(pair: np.ndarray, history: np.ndarray, own: np.ndarray, model: tuple[int, int], weight: float) -> np.ndarray:
    """log10 of the probability of a word after another, from the levels of the pair, the other and the word."""
    n, v = model
    odds = (estimate(own) + SMOOTHING) / (n + SMOOTHING * (v + 1))
    before = estimate(history)
    return np.log10((np.minimum(estimate(pair), before) + weight * odds) / (before + weight))


def _pass(rows: DataFrame, text: str, model: Model, shared, weight: float, each: int | None = None) -> DataFrame:
    """The pass over the texts: what the base score needs and ``score``, a row for each text. Levels of words come from the rows,
    if they have them, else from the word filter.

    With ``each``, the buckets of a part of the pair filter, the pairs aren't looked up: a row for each slice of texts holds
    ``documents`` and ``PAIRS``."""
    totals, key_bits = (model.train_tokens, model.train_words), model.key_bits

    def run(batches):
        word_filter, pair_filter, head = shared.value
        words, exact, known = _Words(), np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                if len(words.names) > CACHE_WORDS:
                    words, exact, known = _Words(), np.empty(0), np.empty(0, np.int64)
                flat, begins = tokens(part.column(text).cast(pa.binary()).to_pylist())
                numbers = words.numbers(flat)
                if fresh := words.names[len(exact):]:
                    guess = np.zeros(len(fresh), np.int64) if word_filter is None else levels(word_filter, _mixed(words.hashes[len(exact):]))
                    known = np.concatenate([known, guess])
                    exact = np.concatenate([exact, np.array([head.get(w, 0) for w in fresh], float)])
                own = known[numbers]
                if word_filter is None:
                    own = np.frombuffer(b"".join(part.column("levels").to_pylist()), np.uint8).astype(np.int64)
                keys, first, inverse = np.unique(_pair_keys(words.hashes[numbers]), return_index=True, return_inverse=True)
                history, latest = np.roll(own, 1)[first], own[first]
                lengths, c = np.diff(np.append(begins, len(flat))), exact[numbers]
                tail = np.flatnonzero(c == 0)
                doc = np.repeat(np.arange(len(begins)), lengths)[tail]
                rare, times = np.unique(doc * len(words.names) + numbers[tail], return_counts=True)
                bounds = np.searchsorted(rare, np.arange(len(begins) + 1) * len(words.names))
                out = {
                    "row": part.column("row"), "key": part.column("key"), "held_out": part.column("held_out"), "n_tokens": pa.array(lengths),
                    "head_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), begins)),
                    "head_log": pa.array(np.add.reduceat(np.where(c > 0, np.log10(c + SMOOTHING), 0.0), begins)),
                    "tail_words": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array([words.names[k] for k in (rare % len(words.names)).tolist()], pa.binary())),
                    "tail_times": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times, pa.int32())),
                }
                if each is None:
                    log_p = _log_p(levels(pair_filter, keys), history, latest, totals, weight)
                    yield pa.RecordBatch.from_pydict(out | {"score": pa.array(np.add.reduceat(log_p[inverse], begins))})
                    continue
                number = (keys >> np.uint64(64 - key_bits)).astype(np.int64) // each
                cuts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
                parts = [{"part": int(number[a]), "start": a, "keys": keys[a:b].tobytes()} for a, b in zip(cuts, [*cuts[1:], len(keys)])]
                documents = pa.StructArray.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], list(out))
                yield pa.RecordBatch.from_pydict({
                    "documents": pa.ListArray.from_arrays(pa.array([0, len(documents)], pa.int32()), documents),
                    "begins": pa.array([begins.tolist()], pa.list_(pa.int32())), "places": pa.array([inverse.astype(np.uint32).tobytes()], pa.binary()),
                    "history": pa.array([history.astype(np.uint8).tobytes()], pa.binary()), "own": pa.array([latest.astype(np.uint8).tobytes()], pa.binary()),
                    "n_pairs": pa.array([len(keys)]),
                    "parts": pa.array([parts], pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int32()), ("keys", pa.binary())]))),
                })

    base = {"row": "long", "key": rows.schema["key"].dataType.simpleString(), **BASE}
    if each is None:
        return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in base.items()) + ", score double")
    return rows.mapInArrow(run, f"documents array<struct<{', '.join(f'{c}: {t}' for c, t in base.items())}>>, {PAIRS}")


def _pair_levels(held: DataFrame, model: Model, each: int, parts: int) -> DataFrame:
    """``slice, start, levels`` for the keys of all slices.

    Blocks of a part of the filter and the keys sent to it meet in a task, blocks first; keys pass through, so a task holds one
    part and never all keys. A part that gets many keys is copied to several tasks."""
    n_keys = held.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).first().n
    copies, key_bits = max(1, math.ceil(n_keys * 8 / (parts * TASK_BYTES))), model.key_bits
    asked = held.select("slice", F.explode("parts").alias("p")).select(
        F.col("p.part").alias("part"), F.pmod("slice", F.lit(copies)).cast("int").alias("copy"), "slice", F.col("p.start").alias("start"),
        F.lit(0).cast("long").alias("size"), F.col("p.keys").alias("data"),
    )
    blocks = model.blocks.where("n = 2").select(
        F.floor(F.col("bucket") / each).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.lit(-1).cast("long").alias("slice"), F.col("bucket").alias("start"), "size", F.col("bits").alias("data"),
    )
    met = blocks.unionByName(asked).repartition(parts * copies, "part", "copy").sortWithinPartitions("part", "copy", "slice")

    def run(batches):
        at, blocks, held = None, [], None
        for batch in batches:
            made = []
            for part, copy, number, start, size, data in zip(*[batch.column(c) for c in ("part", "copy", "slice", "start", "size", "data")]):
                if at != (part.as_py(), copy.as_py()):
                    at, blocks, held = (part.as_py(), copy.as_py()), [], None
                if number.as_py() < 0:
                    blocks.append((start.as_py(), size.as_py(), data.as_py()))
                    continue
                if held is None:
                    held, blocks = _assembled(key_bits, at[0] * each, each, blocks), []
                found = levels(held, np.frombuffer(data.as_buffer(), np.uint64)).astype(np.uint8)
                made.append((number, start, found.tobytes()))
            if made:
                number, start, found = zip(*made)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([x.as_py() for x in number], pa.int64()), "start": pa.array([x.as_py() for x in start], pa.int32()),
                    "levels": pa.array(found, pa.binary()),
                })

    return met.mapInArrow(run, "slice long, start int, levels binary")


def _assembled(key_bits: int, first: int, count: int, blocks: list[tuple[int, int, bytes]]) -> Filter:
    """The filter made of ``bucket, size, bits`` of some of ``count`` buckets."""
    sizes, starts, total = np.zeros(count, np.uint64), np.zeros(count, np.int64), 0
    for bucket, size, _ in blocks:
        sizes[bucket - first], starts[bucket - first] = size, total
        total += size
    return Filter(key_bits, first, count, starts, sizes, np.frombuffer(b"".join(bits for *_, bits in blocks) or bytes(1), np.uint8))


def _probed(rows: DataFrame, text: str, model: Model, shared, weight: float, shards: list[tuple[int, int]]) -> DataFrame:
    """The same rows as those of ``_pass`` for a pair filter of any size, after one pass over the texts: the different keys of
    each slice go to the parts of the filter, and their levels come back to the slice."""
    totals, each = (model.train_tokens, model.train_words), shards[0][1]
    base = _pass(rows, text, model, shared, weight, each)
    held = stage(base.select(F.monotonically_increasing_id().alias("slice"), "*"), "lm-slices")

    def finish(one: pa.Table, answers: pa.Table) -> pa.Table:
        slice_ = one.to_pylist()[0]
        history, own = (np.frombuffer(slice_[c], np.uint8).astype(np.int64) for c in ("history", "own"))
        pair = np.zeros(len(own), np.int64)
        for start, found in zip(answers.column("start").to_pylist(), answers.column("levels").to_pylist()):
            pair[start:start + len(found)] = np.frombuffer(found, np.uint8)
        log_p = _log_p(pair, history, own, totals, weight)
        score = np.add.reduceat(log_p[np.frombuffer(slice_["places"], np.uint32)], slice_["begins"])
        return pa.table({"row": pa.array(slice_["rows"], pa.int64()), "score": pa.array(score)})

    pairs = held.select("slice", F.col("documents.row").alias("rows"), "begins", "places", "history", "own")
    found = _pair_levels(held, model, each, len(shards))
    scores = pairs.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(finish, "row long, score double")
    return held.select(F.explode("documents").alias("d")).select("d.*").join(scores, "row")


def score(docs: DataFrame, model: Model, held_out: Column, *, key: str = "doc_id", text: str = "text", weight: float = 100.0) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    ``score`` adds the log10 probability of each token after the one before it: the pair's count, with ``weight`` times
    the token's own smoothed probability, over the history's count plus ``weight``. ``base_score`` uses exact counts:
    frequent words are looked up in a broadcast of bounded size, the others joined. A null text is empty and has one
    token, its end. Texts are never shuffled. Every row is scored by itself, so repeated rows agree; an empty table gives an
    empty one. Filters larger than their bounds change no score: keys of pairs are sent to the parts
    of theirs, those of words looked up part by part.

    ``score`` is the log10 of what the model gives each token; as quantised counts with false positives needn't add up, these
    needn't sum to one over the vocabulary.
    """
    session = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), held_out.alias("held_out"), F.col(text))
    held = lambda n, shard: tuple(gather(model.blocks, n, model.key_bits, *shard))
    words, pairs = _shards(model.blocks, model.key_bits, 1, WORD_SHARD_BYTES), _shards(model.blocks, model.key_bits, 2, SHARD_BYTES)
    word_filter = held(1, words[0]) if len(words) == 1 else None
    for shard in words if len(words) > 1 else []:
        shared = session.sparkContext.broadcast(held(1, shard))
        rows = stage(_with_levels(rows, text, shared), "lm-levels")
        shared.destroy()
    shared = session.sparkContext.broadcast((word_filter, held(2, pairs[0]) if len(pairs) == 1 else None, _head(model.vocabulary)))
    if len(pairs) == 1:
        base = stage(_pass(rows, text, model, shared, weight), "lm-scores")
    else:
        base = stage(_probed(rows, text, model, shared, weight, _shards(model.blocks, model.key_bits, 2, min(SHARD_BYTES, PROBED_BYTES))), "lm-scores")
    shared.destroy()
    tail = base.select("row", F.explode(F.arrays_zip("tail_words", "tail_times")).alias("t")).select("row", F.col("t.tail_words").alias("word"), F.col("t.tail_times").alias("times"))
    found = tail.join(model.vocabulary, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by_row = found.groupBy("row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("count") + SMOOTHING)).alias("tail_log")
    )
    joined = base.drop("tail_words", "tail_times").join(by_row, "row", "left")
    scale = math.log10(model.train_tokens + SMOOTHING * (model.train_words + 1))
    return joined.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"), "score",
    )


def fit_and_score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 10, **options) -> DataFrame:
    """Learns from the documents whose fold isn't 0 and scores all, with ``held_out`` for those of fold 0."""
    part = fold(key, folds)
    return score(docs, fit(docs.where(part != 0), text=text), part == 0, key=key, text=text, **options)
