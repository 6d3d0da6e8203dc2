"""Every stage of the corpus pipeline against what it must do with its input."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_DIR
from feedloom.llm import simhash


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stage(step(spark, out[-1], SF_DIR), f"test-{name}").cache())
    return dict(zip(["documents", *[n for n, _ in corpus_pipeline.STAGES]], out))


def test_stages_keep_the_columns(steps):
    assert list(steps) == ["documents", "toxicity", "language", "near_duplicates", "mix", "tokens"]
    for name in list(steps)[1:-1]:
        assert steps[name].columns == steps["documents"].columns


def test_filters(spark, steps):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1").collect()}
    ids = {name: [r.doc_id for r in steps[name].select("doc_id").collect()] for name in list(steps)[:4]}
    assert set(ids["toxicity"]) <= set(ids["documents"]) and len(toxic & set(ids["toxicity"])) <= 0.2 * len(toxic)
    assert len(ids["toxicity"]) > 0.8 * len(ids["documents"]) and len(ids["language"]) >= 0.99 * len(ids["toxicity"])


def test_one_of_each_group(steps):
    rows = [(r.doc_id, simhash.fingerprint(r.text.encode())) for r in steps["language"].collect()]
    least = {d: d for d, _ in rows}
    for _ in range(6):
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= 4:
                    least[a] = least[b] = min(least[a], least[b])
    assert sorted(r.doc_id for r in steps["near_duplicates"].collect()) == sorted(set(least.values()))


def test_mix_and_tokens(steps):
    times = collections.Counter(r.doc_id for r in steps["mix"].collect())
    assert set(times) <= {r.doc_id for r in steps["near_duplicates"].collect()} and max(times.values()) <= 2
    rows = steps["tokens"].collect()
    assert collections.Counter(r.doc_id for r in rows) == times and all(r.n_tokens == len(r.ids) for r in rows)


def test_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF_DIR), "test-odd")
    assert "ids" in docs.columns and docs.count() > 0
    docs = no_documents
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF_DIR), "test-empty")
    assert docs.count() == 0


def test_documents_without_a_language_stay(spark):
    """Where no language is stated nothing can be learned, and lettered documents are kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.drop_unknown_language(spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
