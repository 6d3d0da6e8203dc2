"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

Learning reads a bounded sample of labelled texts twice: once for the number of texts of either label that contain each
n-gram, which gives the ratios and the n-grams that tell most, and once for those n-grams of each text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import fold, number_key, output_schema, slices
from feedloom.llm.ngrams import grams, letter_table, letters, sample
from feedloom.session import stage

ORDERS, HASH_BITS = (3, 4, 5, 6), 21
#: Labelled texts to learn from, and n-grams kept, at most.
SAMPLE, FEATURES = 16_000, 2048
LEAST_TEXTS, SMOOTHING, PENALTY, STEPS = 4, 1.0, 1.0, 200
THRESHOLD = 0.3
#: Bytes of text worked on at once; n-grams of all orders take some hundred times as much.
SLICE_BYTES = 1 << 19


class Classifier(NamedTuple):
    """Weight of each kept n-gram, ratio included, by its hash; ``slot`` is -1 for others."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float


def _present(texts, is_letter):
    """Distinct ``(text, n-gram)`` pairs as two arrays."""
    codes, owner, _ = letters(texts, is_letter)
    pairs = [(o.astype(np.int64) << HASH_BITS) | g for o, g in grams(codes, owner, ORDERS, HASH_BITS)]
    both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """``gram, clean, toxic``: the texts of either label that contain each n-gram."""

    def run(batches):
        is_letter, seen = letter_table(), np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                owner, gram = _present(part.column("text").to_pylist(), is_letter)
                toxic = part.column("label").to_numpy()[owner] == 1
                for k, chosen in enumerate((gram[~toxic], gram[toxic])):
                    seen[k] += np.bincount(chosen, minlength=1 << HASH_BITS).astype(np.int32)
        found = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(found), 100_000):
            ids = found[at:at + 100_000]
            yield pa.RecordBatch.from_pydict({"gram": ids, "clean": seen[0, ids].astype(np.int64), "toxic": seen[1, ids].astype(np.int64)})

    return labelled.mapInArrow(run, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _telling(counts: DataFrame, clean: int, toxic: int) -> list:
    """The n-grams whose presence differs most between the labels, by the likelihood-ratio statistic."""
    n, total = F.col("clean") + F.col("toxic"), float(clean + toxic)

    def term(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    g = term(F.col("toxic"), n, F.lit(float(toxic))) + term(F.col("clean"), n, F.lit(float(clean)))
    rest = total - n
    g = g + term(toxic - F.col("toxic"), rest, F.lit(float(toxic))) + term(clean - F.col("clean"), rest, F.lit(float(clean)))
    return counts.where(n >= LEAST_TEXTS).withColumn("g", g).orderBy(F.desc("g"), "gram").limit(FEATURES).select("gram", "clean", "toxic").collect()


def _features(labelled: DataFrame, slot: np.ndarray):
    """Kept n-grams of every sampled text, gathered: at most ``SAMPLE`` rows."""
    shared = labelled.sparkSession.sparkContext.broadcast(slot)

    def run(batches):
        is_letter, slots = letter_table(), shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                owner, gram = _present(part.column("text").to_pylist(), is_letter)
                kept = slots[gram] >= 0
                owner, gram = owner[kept], gram[kept]
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_pydict({"doc_key": part.column("doc_key"), "label": part.column("label"), "x": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(slots[gram].astype(np.int16)))})

    table = labelled.mapInArrow(run, "doc_key long, label int, x array<smallint>").toArrow()
    table = table.sort_by([("doc_key", "ascending"), ("label", "ascending")]).combine_chunks()
    column = table.column("x").combine_chunks()
    return table.column("label").to_numpy().astype(float), column.offsets.to_numpy().astype(np.int64), column.flatten().to_numpy().astype(np.int64)


def _descend(y: np.ndarray, bounds: np.ndarray, x: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on the scaled features, by accelerated gradient steps of adaptive size."""
    owner = np.repeat(np.arange(len(y)), np.diff(bounds))
    w, bias = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    moment, spread = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1):
        margin = bias + np.bincount(owner, (w * ratio)[x], len(y))
        off = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        slope = np.append((np.bincount(x, off[owner], len(ratio)) * ratio + PENALTY * w) / len(y), off.mean())
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        move = 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w * ratio, bias


def fit(labelled: DataFrame) -> Classifier:
    """Learns from rows of ``doc_key, text, label``; the caller bounds their number. Without rows of both labels the
    score of every text is the share of label 1, smoothed."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    slot = np.full(1 << HASH_BITS, -1, np.int16)
    if not clean or not toxic:
        return Classifier(slot, np.zeros(1), float(np.log((toxic + 1) / (clean + 1))))
    rows = _telling(_gram_counts(labelled), clean, toxic)
    if not rows:
        return Classifier(slot, np.zeros(1), float(np.log((toxic + 1) / (clean + 1))))
    slot[[r.gram for r in rows]] = np.arange(len(rows))
    p, q = np.array([r.toxic for r in rows]) + SMOOTHING, np.array([r.clean for r in rows]) + SMOOTHING
    ratio = np.log((p / (toxic + 2 * SMOOTHING)) / (q / (clean + 2 * SMOOTHING)))
    weights, bias = _descend(*_features(labelled, slot), ratio)
    return Classifier(slot, weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """``doc_key, text, label`` of at most ``most`` labelled documents, drawn by the hashes of their ids.

    The drawn labels, 16 bytes each, are few by that bound and broadcast, so texts are not shuffled. Null labels and ids
    are left out. Repeated ids give a row for each pair.
    """
    drawn = sample(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(number_key(labels, key).alias("doc_key"), F.col(label).cast("int").alias("label")), "doc_key", most)
    texts = docs.select(number_key(docs, key).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_key").select("doc_key", "text", "label")


def score(docs: DataFrame, model: Classifier, *, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` without the text, with the probability of label 1 in ``output``. Null and empty texts have
    that of a text without any kept n-gram. Every row is scored by itself, so repeated rows agree, and an empty table gives
    an empty one. A column named like the output is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        is_letter, (slot, weights, bias) = letter_table(), shared.value
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                codes, owner, _ = letters(part.column(text).to_pylist(), is_letter)
                found = []
                for o, g in grams(codes, owner, ORDERS, HASH_BITS):
                    at = slot[g]
                    kept = at >= 0
                    found.append(o[kept].astype(np.int64) * len(weights) + at[kept])
                pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                margin = bias + np.bincount(pairs // len(weights), weights[pairs % len(weights)], part.num_rows)
                kept = {n: part.column(n) for n in part.schema.names if n not in (text, output)}
                yield pa.RecordBatch.from_pydict({**kept, output: 1 / (1 + np.exp(-np.clip(margin, -30, 30)))})

    return docs.mapInArrow(run, output_schema(docs.drop(text), **{output: "double"}))


def fit_and_score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, out_fold: int = 2) -> DataFrame:
    """``key, held_out, score, predicted`` of every document; learns from labelled ones outside fold ``out_fold``."""
    part = fold(key, folds)
    rows = training_rows(docs.where(part != out_fold), labels.where(part != out_fold), key=key, text=text, label=label)
    model = fit(stage(rows, "toxicity-sample"))
    scored = score(docs.select(F.col(key), (part == out_fold).alias("held_out"), F.col(text).alias("text")), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
