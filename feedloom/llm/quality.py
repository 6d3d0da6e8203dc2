"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Tokens are runs of letters and digits, or of ASCII punctuation. Words and pairs of neighbours are hashed into buckets, and two
multinomials over the buckets are counted: one over all documents, one over trusted ones. A document's score is the mean
logarithm, over its n-grams, of the trusted by the raw probability, so its length doesn't matter. The threshold lies at a
small share of the scores of trusted documents, each by the others, and every document is held against it; nothing is drawn
by chance.

Logarithms are rounded to thousandths and summed as integers, so neither the order of rows nor the number of tasks shows.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from feedloom.llm.common import output_schema, slices
from feedloom.llm.factors import extended, repeated, word_names
from feedloom.llm.ngrams import sample
from feedloom.session import stage

BUCKETS = 1 << 14
SMOOTHING, UNIT = 1, 1000
#: One trusted document in so many lies below the threshold.
ONE_IN = 500
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
PAIR_FACTOR, PAIR_SALT = 31, 7
SLICE_BYTES = 1 << 20
#: Rows of trusted ids that are broadcast, some 50 MB in memory: 33 million ids that lie close, or half a million of any kind.
BROADCAST_ROWS = 1 << 19

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
SYMBOLS = b"#*$%&|<>"
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
SCORE = {"n_grams": "long", "total": "long"}


def buckets_of(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and every pair of neighbouring words, and the text it belongs to."""
    tokens = [TOKEN.findall(t) for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for words in tokens for w in words))}
    if not known:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = np.frombuffer(b"".join(hashlib.md5(w).digest()[:4] for w in known), ">u4").astype(np.int64)
    h = hashes[np.fromiter((known[w] for words in tokens for w in words), np.int64)]
    owner = np.repeat(np.arange(len(texts)), list(map(len, tokens)))
    inside = owner[1:] == owner[:-1]
    pairs = (h[:-1] * PAIR_FACTOR + h[1:] + PAIR_SALT)[inside] % buckets
    return np.concatenate([h % buckets, pairs]), np.concatenate([owner, owner[1:][inside]])


def _repeat_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of words found at least twice in it."""
    names, bounds = word_names(words)
    one = repeated(np.arange(len(names)), names)
    made, length = one, 1
    while 2 * length <= window:
        made = repeated(*extended(*made, length, *made))
        length *= 2
    while length < window:
        made = repeated(*extended(*made, length, *one))
        length += 1
    change = np.zeros(len(names) + 1, np.int64)
    np.add.at(change, made[0], 1)
    np.add.at(change, made[0] + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    worded = [line for line in lines if line.strip()]
    return len(worded) - len(set(worded))


_BYTE = np.arange(256)
_BLANK = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_STARTS_WORD_CHAR = ~_BLANK & ((_BYTE & 0xC0) != 0x80)
_SYMBOL = np.isin(_BYTE, list(SYMBOLS))


def base_measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    words = [t.split() for t in texts]
    codes = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])

    def count(wanted: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(wanted[codes])])
        return so_far[ends[1:]] - so_far[ends[:-1]]

    return {
        "n_words": np.fromiter(map(len, words), np.int64, len(words)), "word_chars": count(_STARTS_WORD_CHAR), "n_symbols": count(_SYMBOL),
        "n_dup_lines": np.fromiter(map(_dup_lines, texts), np.int64, len(texts)), "n_repeat_words": _repeat_words(words),
    }


def _texts(part, text: str) -> list[bytes]:
    return [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]


def _trusted_words(trusted: DataFrame) -> DataFrame:
    """``_word, _bits``: whole ids as bits of words of 64 neighbouring ones."""
    number = F.col("_trusted_key").cast("long")
    return trusted.groupBy(F.shiftright(number, 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _place(number))).alias("_bits"))


def _place(number):
    return number.bitwiseAND(63).cast("int")


def flag_trusted(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", most: int | None = None, output: str = "trusted") -> DataFrame:
    """``docs`` with a flag on all that some row of ``labels`` gives label 1; with ``most``, on so many ids of them, those with
    the smallest hashes. Null ids are never trusted; repeated ones all are.

    Whole ids are packed as bits, 64 neighbouring ones to a row, others are a row each. Up to ``BROADCAST_ROWS`` such rows are
    broadcast, so that no text is moved; beyond that a join deals the documents out by id."""
    trusted = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_trusted_key")).distinct()
    trusted = trusted if most is None else sample(trusted, "_trusted_key", most)
    packed = all(isinstance(df.schema[key].dataType, IntegralType) for df in (docs, labels))
    rows = stage(_trusted_words(trusted) if packed else trusted, "trusted-ids")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    if packed:
        number = F.col(key).cast("long")
        flagged = docs.join(rows, F.shiftright(number, 6) == F.col("_word"), "left")
        bit = F.call_function("shiftright", F.col("_bits"), _place(number)).bitwiseAND(1)
        return flagged.withColumn(output, F.coalesce(bit == 1, F.lit(False))).drop("_word", "_bits")
    flagged = docs.join(rows, F.col(key).cast("string") == F.col("_trusted_key"), "left")
    return flagged.withColumn(output, F.col("_trusted_key").isNotNull()).drop("_trusted_key")


def gram_counts(flagged: DataFrame, *, text: str = "text", flag: str = "trusted", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, trusted``: n-grams of all texts and of trusted ones. A task sends at most a row a bucket."""

    def run(batches):
        seen = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found, owner = buckets_of(_texts(part, text), buckets)
                chosen = part.column(flag).to_numpy(zero_copy_only=False).astype(bool)[owner]
                seen[0] += np.bincount(found, minlength=buckets)
                seen[1] += np.bincount(found[chosen], minlength=buckets)
        ids = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_pydict({"bucket": ids, "raw": seen[0, ids], "trusted": seen[1, ids]})

    counted = flagged.select(text, flag).mapInArrow(run, "bucket long, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


class Model(NamedTuple):
    """Counts of every bucket, over all documents and over trusted ones."""

    raw: np.ndarray
    trusted: np.ndarray

    def weights(self, bucket: np.ndarray, own: np.ndarray | int = 0, own_all: np.ndarray | int = 0) -> np.ndarray:
        """Thousandths of the log ratio of the smoothed probabilities, zero where nothing is trusted; ``own`` of the bucket's
        trusted n-grams, and ``own_all`` of all, are left out."""
        if not self.trusted.sum():
            return np.zeros(len(bucket), np.int64)
        room = SMOOTHING * len(self.raw)
        good = (self.trusted[bucket] - own + SMOOTHING) / (self.trusted.sum() - own_all + room).astype(float)
        every = (self.raw[bucket] + SMOOTHING) / float(self.raw.sum() + room)
        return np.rint(UNIT * (np.log(good) - np.log(every))).astype(np.int64)


def learn(flagged: DataFrame, *, text: str = "text", flag: str = "trusted", buckets: int = BUCKETS) -> Model:
    """Counts of all buckets; the driver gets a row a bucket."""
    model = Model(np.zeros(buckets, np.int64), np.zeros(buckets, np.int64))
    for r in gram_counts(flagged, text=text, flag=flag, buckets=buckets).collect():
        model.raw[r.bucket], model.trusted[r.bucket] = r.raw, r.trusted
    return model


def _totals(found: np.ndarray, owner: np.ndarray, n: int, trusted: np.ndarray, weights: np.ndarray, model: Model) -> np.ndarray:
    """Sum of the weights of each text's n-grams. Sums of thousandths stay far below 2^53, where doubles are exact."""
    total = np.bincount(owner, weights[found], n)
    grams, chosen = np.bincount(owner, minlength=n), trusted[owner]
    if chosen.any():
        pairs, times = np.unique(owner[chosen] * len(weights) + found[chosen], return_counts=True)
        text, bucket = pairs // len(weights), pairs % len(weights)
        without = np.bincount(text, times * model.weights(bucket, times, grams[text]), n)
        total = np.where(trusted, without, total)
    return total.astype(np.int64)


def measure(flagged: DataFrame, model: Model, *, text: str = "text", flag: str = "trusted") -> DataFrame:
    """``flagged`` without the text, with the plain counts, ``n_grams`` and ``total``, the sum of their weights. A trusted
    document is weighed by the other trusted ones, so that those few don't score above their like.

    A null or empty text has zero in all of them. Columns with these names are replaced.
    """
    shared, added = flagged.sparkSession.sparkContext.broadcast(tuple(model)), BASE | SCORE

    def run(batches):
        learned = Model(*shared.value)
        weights = learned.weights(np.arange(len(learned.raw)))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                texts, trusted = _texts(part, text), part.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                found, owner = buckets_of(texts, len(weights))
                made = {
                    **base_measures(texts), "n_grams": np.bincount(owner, minlength=len(texts)),
                    "total": _totals(found, owner, len(texts), trusted, weights, learned),
                }
                yield pa.RecordBatch.from_pydict({**{n: part.column(n) for n in part.schema.names if n != text and n not in added}, **made})

    return flagged.mapInArrow(run, output_schema(flagged.drop(text), **added))


def _thousandths():
    """Mean log ratio in thousandths, rounded down; zero for a text without n-grams."""
    return F.when(F.col("n_grams") > 0, F.floor(F.col("total") / F.col("n_grams"))).otherwise(0).cast("long")


def threshold_of(measured: DataFrame, *, flag: str = "trusted", one_in: int = ONE_IN) -> int | None:
    """The thousandths that one trusted document in ``one_in`` lies below; None without trusted documents. The driver gets
    a row for each thousandth that occurs; log ratios bound their number, whatever the number of documents."""
    rows = measured.where(F.col(flag)).groupBy(_thousandths().alias("at")).count().orderBy("at").collect()
    rank, below = sum(r["count"] for r in rows) // one_in, 0
    for r in rows:
        below += r["count"]
        if below > rank:
            return r["at"]
    return None


def judged(measured: DataFrame, threshold: int | None) -> DataFrame:
    """Adds ``score``, the mean log ratio, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    score = F.when(F.col("n_grams") > 0, F.col("total") / (F.col("n_grams") * float(UNIT))).otherwise(0.0)
    passed = F.lit(True) if threshold is None else _thousandths() >= threshold
    return measured.withColumns({"score": score, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & passed)


def fit_and_judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key``, the plain counts, ``n_grams``, ``total``, ``score``, ``base_failed`` and ``kept`` of every document.

    Null and empty texts have no words and fail the plain rules. Equal texts get equal results, but that a trusted one is
    weighed without itself; a score in the thousandth of the threshold is kept. Without labels of 1 nothing is learned and the plain rules alone decide. An empty table
    gives an empty one. Only the key and the text are read, so other columns can't clash.
    """
    flagged = flag_trusted(docs.select(F.col(key), F.col(text).alias("text")), labels, key=key, label=label)
    measured = stage(measure(flagged, learn(flagged)), "quality-measures")
    return judged(measured, threshold_of(measured)).drop("trusted")
