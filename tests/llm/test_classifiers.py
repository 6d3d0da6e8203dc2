"""Toxicity and language identification: held-out accuracy and odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import langid, ngrams, toxicity


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_toxicity_of_held_out_texts(larger):
    docs, labels = larger
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.fit_and_score(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [(marked[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marked]
    hits = sum(a == b == 1 for a, b in out)
    assert hits >= 0.65 * sum(a for a, _ in out) and sum(b and not a for a, b in out) <= 0.02 * len(out)


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents, larger):
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (2, 0, "x"), (6, None, "x"), (None, 1, "x"), (9, 1, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.fit_and_score(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    empty = labels.where("false")
    assert {r.score for r in toxicity.fit_and_score(odd_documents, empty).collect()} == {0.5}
    assert toxicity.fit_and_score(no_documents, labels).collect() == []


def test_sample_is_bounded_and_repeatable(larger):
    _, labels = larger
    drawn = ngrams.sample(labels, "doc_id", 50).collect()
    assert len(drawn) == 50 and sorted(drawn) == sorted(ngrams.sample(labels.repartition(3), "doc_id", 50).collect())


def test_language_of_held_out_texts(larger):
    docs, _ = larger
    stated = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.fit_and_predict(docs).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(stated) and np.mean([r.lang_pred == stated[r.doc_id] for r in out]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.005 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_documents(odd_documents, no_documents, larger):
    docs, _ = larger
    model = langid.fit(docs.selectExpr("lang", "cast(doc_id as string) as doc_key", "text"))
    rows = {r.doc_id: r for r in langid.predict(odd_documents, model).collect() if r.doc_id is not None}
    for d in (3, 4, 5, 10):
        assert (rows[d].lang_pred, rows[d].score, rows[d].rejected) == ("und", 0.0, True)
    assert rows[9].rejected and rows[9].lang_pred != "und"
    assert len(langid.fit_and_predict(odd_documents).collect()) == odd_documents.count()
    assert langid.fit_and_predict(no_documents).collect() == []
    # nothing to learn from: nothing speaks against a text with letters
    unlearned = langid.fit_and_predict(odd_documents.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}
    assert sorted(r.doc_id for r in unlearned if r.rejected and r.doc_id is not None) == [3, 4, 5, 10]


def plain_letters(text):
    out = " "
    for c in f" {(text or '').lower()} ":
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return out


def plain_grams(text, orders, bits):
    """Hashed n-grams of a text, one at a time."""
    letters, found = plain_letters(text), []
    for n in orders:
        for i in range(len(letters) - n + 1):
            h = 0
            for c in letters[i:i + n]:
                h = (h * ngrams.FACTOR + ord(c)) % 2**32
            h = (h ^ (n * ngrams.SALT % 2**32)) * ngrams.SALT % 2**32
            found.append((h ^ (h >> 15)) * ngrams.FACTOR % 2**32 >> (32 - bits))
    return found


WORDS = {0: "calm words about rivers and quiet hills", 1: "vile nasty slurs hate rage spite"}


@pytest.fixture(scope="module")
def small(spark):
    pick = np.random.default_rng(3)
    rows = []
    for i in range(60):
        label = int(i % 3 == 0)
        words = WORDS[label].split() + ["The", "É1", "of"]
        rows.append((i, " ".join(pick.choice(words, 12)), label, "ab"[label]))
    return rows, spark.createDataFrame(rows, "doc_key long, text string, label int, lang string")


def test_toxicity_against_plain_python(spark, small):
    rows, df = small
    present = {i: set(plain_grams(t, toxicity.ORDERS, toxicity.HASH_BITS)) for i, t, _, _ in rows}
    seen = [Counter(g for i, _, label, _ in rows if label == k for g in present[i]) for k in (0, 1)]
    counted = {r.gram: (r.clean, r.toxic) for r in toxicity._gram_counts(df.select("doc_key", "text", "label")).collect()}
    assert counted == {g: (seen[0][g], seen[1][g]) for g in seen[0] | seen[1]}
    sizes = [sum(label == k for _, _, label, _ in rows) for k in (0, 1)]

    def telling(g):
        cells = [(seen[k][g], sizes[k], seen[0][g] + seen[1][g]) for k in (0, 1)]
        cells += [(n - c, n, len(rows) - row) for c, n, row in cells]
        return sum(c * math.log(c * len(rows) / (n * row)) for c, n, row in cells if c)

    model = toxicity.fit(df.select("doc_key", "text", "label"))
    kept = set(np.flatnonzero(model.slot >= 0).tolist())
    possible = [g for g in counted if sum(counted[g]) >= toxicity.LEAST_TEXTS]
    bar = sorted(map(telling, possible), reverse=True)[:toxicity.FEATURES][-1]
    assert kept <= set(possible) and len(kept) == min(toxicity.FEATURES, len(possible)) and min(map(telling, kept)) >= bar - 1e-9
    # Every weight is the n-gram's log-count ratio times a coefficient; the loss can't be made smaller by any of them.
    ratio = {g: math.log((seen[1][g] + 1) / (sizes[1] + 2)) - math.log((seen[0][g] + 1) / (sizes[0] + 2)) for g in kept}
    scored = {r.doc_key: r.score for r in toxicity.score(df, model).collect()}
    for i, _, _, _ in rows:
        margin = model.bias + sum(model.weights[model.slot[g]] for g in present[i] & kept)
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)
    off = {i: scored[i] - label for i, _, label, _ in rows}
    for g in kept:
        if abs(ratio[g]) > 1e-9:
            slope = sum(off[i] for i in off if g in present[i]) * ratio[g] + toxicity.PENALTY * model.weights[model.slot[g]] / ratio[g]
            assert abs(slope) / len(rows) < 0.02
    assert [scored[i] >= toxicity.THRESHOLD for i, _, _, _ in rows] == [bool(label) for _, _, label, _ in rows]


def test_language_against_plain_python(spark, small):
    rows, df = small
    model = langid.fit(df.selectExpr("lang", "cast(doc_key as string) as doc_key", "text"))
    counts = {i: Counter(plain_grams(t, langid.ORDERS, langid.HASH_BITS)) for i, t, _, _ in rows}
    spread = Counter(g for c in counts.values() for g in c)
    for g in range(langid.DIMENSIONS):
        assert model.idf[g] == pytest.approx(1 + math.log((1 + len(rows)) / (1 + spread[g])) if spread[g] else 1.0, rel=1e-5)
    assert sorted(set(model.languages)) == ["a", "b"] and model.languages == sorted(model.languages)
    vector = {}
    for i, c in counts.items():
        x = np.zeros(langid.DIMENSIONS)
        for g, n in c.items():
            x[g] = math.log1p(n) * model.idf[g]
        vector[i] = x / np.linalg.norm(x)
    # Each centroid is the direction of the mean of the texts of its language that are nearest to it.
    for lang in "ab":
        own = [i for i, _, _, k in rows if k == lang]
        unit = model.unit[[k == lang for k in model.languages]]
        near = {i: int((unit @ vector[i]).argmax()) for i in own}
        for j, centre in enumerate(unit):
            mean = np.mean([vector[i] for i in own if near[i] == j], axis=0)
            assert np.allclose(centre, mean / np.linalg.norm(mean), atol=1e-4)
    best = {i: (model.unit @ x) for i, x in vector.items()}
    for r in langid.predict(df, model).collect():
        assert r.lang_pred == model.languages[int(best[r.doc_key].argmax())] and r.score == pytest.approx(best[r.doc_key].max(), rel=1e-4)
        letters = sum(c.isalpha() for c in rows[r.doc_key][1])
        assert r.rejected == (r.score < model.least[min(int(math.log2(letters)) // 2, langid.CLASSES - 1)])
    size = [min(int(math.log2(sum(c.isalpha() for c in t))) // 2, langid.CLASSES - 1) for _, t, _, _ in rows]
    for k in set(size):
        assert model.least[k] == pytest.approx(langid.SLACK * np.quantile([best[i].max() for i in best if size[i] == k], langid.ODD_SHARE), rel=1e-4)
    # Lengths of which no text was learned from take the bound of the nearest one.
    assert (model.least > 0).all()


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", WORDS[i % 2] * (1 + i % 3)) for i in range(20)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(20)], "doc_id string, toxic int")
    rows = toxicity.fit_and_score(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(f"d{i}" for i in range(20)) and [r.predicted for r in sorted(rows, key=lambda r: int(r.doc_id[1:]))] == [0, 1] * 10


def test_clusters_have_a_centroid_each():
    rng = np.random.default_rng(2)
    corners = np.eye(5, dtype=np.float32)[[0, 2, 4]]
    x = np.repeat(corners, 30, axis=0) + rng.normal(0, 0.02, (90, 5)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = langid.cluster(x, 3)
    assert np.allclose(np.sort(found.argmax(axis=1)), [0, 2, 4]) and (found.max(axis=1) > 0.99).all()
