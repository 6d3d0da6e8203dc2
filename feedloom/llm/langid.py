"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed character n-grams. Each language's sampled vectors are clustered, so
that its kinds of text have centroids of their own. A text takes the language of the most similar centroid, and is
rejected when it is farther from every centroid than texts of its length were that were learned from.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedloom.llm.common import fold, output_schema, slices
from feedloom.llm.ngrams import chance, grams, letter_table, letters
from feedloom.session import stage

ORDERS, HASH_BITS = (1, 2, 3), 13
DIMENSIONS = 1 << HASH_BITS
#: Texts of each language to learn from, at most, centroids for each, and rounds of clustering.
SAMPLE, CENTROIDS, ROUNDS = 1000, 4, 12
#: A text is rejected if its similarity is below this share of what all but a hundredth of the sampled texts of its length
#: reach, so that a few odd texts among them don't set the bound.
SLACK, ODD_SHARE = 0.5, 0.01
#: Length classes of the rejection bound: powers of four of the number of letters.
CLASSES = 12
UNDETERMINED = "und"
TEXTS_AT_ONCE = 256


class Centroids(NamedTuple):
    """``unit`` has a row for each centroid, of the language at the same place of ``languages``; ``idf`` weighs the
    dimensions; ``least`` is the similarity that each length class needs."""

    languages: list[str]
    unit: np.ndarray
    idf: np.ndarray
    least: np.ndarray


def _length_class(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64) // 2, CLASSES - 1)


def _counts(texts: list[str | None], is_letter: np.ndarray):
    """N-gram counts of up to ``TEXTS_AT_ONCE`` texts as rows of a matrix, and the letters of each text."""
    codes, owner, n_letters = letters(texts, is_letter)
    counts = np.zeros(len(texts) * DIMENSIONS, np.float32)
    for o, g in grams(codes, owner, ORDERS, HASH_BITS):
        counts += np.bincount(o.astype(np.int64) * DIMENSIONS + g, minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(texts), DIMENSIONS), n_letters


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped counts times inverse document frequencies, of length one; rows without counts stay zero."""
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def sample(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` rows of each ``lang``, of the smallest hashes of ``doc_key``. Rows that can't be among them are
    dropped by a bound on the hash before any is moved."""
    sizes = F.broadcast(stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes"))
    near = rows.join(sizes, "lang").withColumn("chance", chance("doc_key")).where(F.col("chance") * F.col("n") <= 1.3 * most + 30)
    order = Window.partitionBy("lang").orderBy("chance", "doc_key")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("lang", "doc_key", "text")


def _sparse(sampled: DataFrame) -> DataFrame:
    """``lang, doc_key, n_letters, gram, times`` of each sampled text, as lists."""

    def run(batches):
        is_letter = letter_table()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                counts, n_letters = _counts(part.column("text").to_pylist(), is_letter)
                row, gram = np.nonzero(counts)
                bounds = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "lang": part.column("lang"), "doc_key": part.column("doc_key"), "n_letters": n_letters.astype(np.int64),
                    "gram": pa.ListArray.from_arrays(bounds, pa.array(gram, pa.int32())), "times": pa.ListArray.from_arrays(bounds, pa.array(counts[row, gram])),
                })

    return sampled.mapInArrow(run, "lang string, doc_key string, n_letters long, gram array<int>, times array<float>")


def _dense(table: pa.Table, idf: np.ndarray) -> np.ndarray:
    gram, times = table.column("gram").combine_chunks(), table.column("times").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), np.diff(gram.offsets.to_numpy()))
    counts = np.zeros((table.num_rows, DIMENSIONS), np.float32)
    counts[row, gram.flatten().to_numpy()] = times.flatten().to_numpy()
    return _unit(counts, idf)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit rows by cosine. The first is the mean; each further one starts at the row least like those
    before it, then rows and centroids are fitted to each other."""
    centre = [x.mean(axis=0)]
    near = x @ centre[0] / max(np.linalg.norm(centre[0]), 1e-12)
    for _ in range(1, min(k, len(x))):
        centre.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centre[-1])
    c = np.array(centre)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, *, most: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Learns from rows of ``lang, doc_key, text``, of which at most ``most`` for each language are used.

    The model, ``centroids`` rows of ``DIMENSIONS`` floats for each language, is all that reaches the driver.
    """
    session = labelled.sparkSession
    rows = stage(_sparse(sample(labelled, most)).where("n_letters > 0"), "langid-sample")
    total = rows.count()
    idf = np.ones(DIMENSIONS, np.float32)
    for r in rows.select(F.explode("gram").alias("gram")).groupBy("gram").count().collect():
        idf[r.gram] = 1.0 + np.log((1 + total) / (1 + r["count"]))

    def centres(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_key", "ascending"), ("n_letters", "ascending")]).combine_chunks()
        found = cluster(_dense(table, idf), centroids)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found)), "centre": pa.array(list(found), pa.list_(pa.float32()))})

    found = rows.groupBy("lang").applyInArrow(centres, "lang string, centre array<float>").collect()
    found.sort(key=lambda r: (r.lang, r.centre))
    unit = np.array([r.centre for r in found], np.float32).reshape(len(found), DIMENSIONS)
    shared = session.sparkContext.broadcast((unit, idf))

    def nearest(batches):
        unit, idf = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            if table.num_rows:
                best = (_dense(table, idf) @ unit.T).max(axis=1)
                yield pa.RecordBatch.from_pydict({"class": _length_class(table.column("n_letters").to_numpy()), "best": best.astype(np.float64)})

    least = np.zeros(CLASSES)
    if found:
        for r in rows.mapInArrow(nearest, "class long, best double").groupBy("class").agg(F.percentile("best", ODD_SHARE).alias("least")).collect():
            least[r["class"]] = SLACK * r.least
        least = _filled(least)
    return Centroids([r.lang for r in found], unit, idf, least)


def _filled(least: np.ndarray) -> np.ndarray:
    """Classes without a sampled text take the bound of the nearest class with one, the shorter of two."""
    filled = np.flatnonzero(least)
    return least[filled[np.abs(filled[None, :] - np.arange(len(least))[:, None]).argmin(axis=1)]] if len(filled) else least


def predict(docs: DataFrame, model: Centroids, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the similarity to the nearest centroid. A text that is null or has no letter is ``und`` with score 0
    and rejected. Other texts always name the nearest language, rejected or not, the first in code point order of equally
    near ones; if nothing was learned they are ``und`` too, but not rejected, as nothing speaks against them. Every row is
    judged by itself, so repeated rows agree; an empty table gives an empty one, and columns with the names of added ones
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        languages, unit, idf, least = shared.value
        is_letter, names = letter_table(), np.array([*languages, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, text):
                for start in range(0, part.num_rows, TEXTS_AT_ONCE):
                    few = part.slice(start, TEXTS_AT_ONCE)
                    counts, n_letters = _counts(few.column(text).to_pylist(), is_letter)
                    best, score = np.full(few.num_rows, len(languages)), np.zeros(few.num_rows)
                    if languages:
                        similarity = _unit(counts, idf) @ unit.T
                        known = n_letters > 0
                        best = np.where(known, similarity.argmax(axis=1), best)
                        score = np.where(known, np.clip(similarity.max(axis=1), 0, 1), 0.0).astype(np.float64)
                    rejected = (n_letters == 0) | (score < least[_length_class(n_letters)])
                    kept = {n: few.column(n) for n in few.schema.names if n not in (text, "lang_pred", "score", "rejected")}
                    yield pa.RecordBatch.from_pydict({**kept, "lang_pred": pa.array(names[best], pa.string()), "score": score, "rejected": rejected})

    return docs.mapInArrow(run, output_schema(docs.drop(text), lang_pred="string", score="double", rejected="boolean"))


def fit_and_predict(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, out_fold: int = 1) -> DataFrame:
    """``key, held_out, lang_pred, score, rejected`` of every document; learns from those with a language outside fold
    ``out_fold``."""
    part = fold(key, folds)
    known = docs.where((part != out_fold) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    model = fit(known.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc_key"), F.col(text).alias("text")))
    return predict(docs.select(F.col(key), (part == out_fold).alias("held_out"), F.col(text).alias("text")), model)
