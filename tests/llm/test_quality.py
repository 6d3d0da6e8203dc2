"""Quality rules against plain Python; odd rows and held-out labels. The query itself has SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF_DIR
from feedloom.llm import quality


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)), "n_repeat_words": len(inside),
    }


def plain_buckets(text):
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", text)
    h = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in tokens]
    return [x % quality.BUCKETS for x in h] + [(31 * a + b + 7) % quality.BUCKETS for a, b in zip(h, h[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#|é中< ", max_size=80) | st.just("a b c d e\n" * 4), max_size=4))
def test_measures(texts):
    got = quality.base_measures([t.encode() for t in texts])
    assert [{c: int(v[i]) for c, v in got.items()} for i in range(len(texts))] == [plain_measures(t) for t in texts]
    found, owner = quality.buckets_of([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(found[owner == i].tolist()) == sorted(plain_buckets(t))


def test_against_plain_python(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    docs = {r.doc_id: r.text or "" for r in documents.collect()}
    raw, good = Counter(), Counter()
    for d, t in docs.items():
        raw.update(plain_buckets(t))
        if d in trusted:
            good.update(plain_buckets(t))
    n_raw, n_good = sum(raw.values()), sum(good.values())
    means = {}
    for d, t in docs.items():
        own = Counter(plain_buckets(t))
        out, n = (own, sum(own.values())) if d in trusted else (Counter(), 0)
        weight = {b: round(1000 * (math.log((good[b] - out[b] + 1) / (n_good - n + quality.BUCKETS)) - math.log((raw[b] + 1) / (n_raw + quality.BUCKETS)))) for b in own}
        means[d] = math.floor(sum(weight[b] * c for b, c in own.items()) / sum(own.values())) if own else 0
    least = sorted(means[d] for d in trusted if d in docs)
    least = least[len(least) // 500]
    for r in quality.fit_and_judge(documents, labels).collect():
        want = plain_measures(docs[r.doc_id])
        assert {c: r[c] for c in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert (r.base_failed, r.kept) == (failed, not failed and means[r.doc_id] >= least)


def test_held_out_labels(spark):
    """Documents labelled good but not learned from stay; those labelled bad go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mark = {r.doc_id: r.quality for r in labels.collect()}
    learned = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    rows = [r for r in quality.fit_and_judge(docs, learned).collect() if r.doc_id in mark and zlib.crc32(str(r.doc_id).encode()) % 2]
    assert np.mean([r.kept for r in rows if mark[r.doc_id] == 1 and not r.base_failed]) > 0.95
    assert np.mean([not r.kept for r in rows if mark[r.doc_id] == 0]) > 0.9


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (2, 0, "x"), (6, None, "x"), (None, 1, "x"), (9, 0, "x")], "doc_id long, quality int, text string")
    rows = quality.fit_and_judge(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.n_words, r.n_grams, r.total, r.score, r.base_failed, r.kept) == (0, 0, 0, 0.0, True, False)
    twice = [tuple(r) for r in rows if r.doc_id == 2]
    assert twice[0] == twice[1]
    unlearned = quality.fit_and_judge(odd_documents, labels.where("false")).collect()
    assert all(r.kept != r.base_failed and r.total == 0 for r in unlearned)
    assert quality.fit_and_judge(no_documents, labels).collect() == []
    clashing = odd_documents.withColumnRenamed("n", "n_words").withColumnRenamed("u", "trusted").withColumnRenamed("ids", "total")
    flagged = quality.flag_trusted(clashing, labels)
    assert flagged.where("trusted").count() == 3
    assert quality.measure(flagged, quality.learn(flagged)).count() == odd_documents.count()


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "some good words " * 5), ("b", None)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1)], "doc_id string, quality int")
    assert {r.doc_id: r.n_words for r in quality.fit_and_judge(docs, labels).collect()} == {"a": 15, "b": 0}


def test_trusted_ids_are_bounded(spark, documents):
    labels = documents.selectExpr("doc_id", "1 as quality")
    assert quality.flag_trusted(documents, labels, most=20).where("trusted").count() == 20


@pytest.mark.parametrize("parts", [1, 7])
def test_parts_do_not_show(spark, documents, parts):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = quality.fit_and_judge(documents.repartition(parts), labels).collect()
    assert sorted(rows) == sorted(quality.fit_and_judge(documents, labels).collect())


def test_all_trusted_documents_count(spark):
    """More of them than the 16,000 that were once drawn: each is flagged, and each is in the counts."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'word' AS text")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 20 <> 0 AS INT) AS quality")
    flagged = quality.flag_trusted(docs, labels)
    assert flagged.where("trusted").count() == 19_000
    model = quality.learn(flagged)
    assert model.raw.sum() == 20_000 and model.trusted.sum() == 19_000


@pytest.mark.parametrize("most_rows", [quality.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_trusted_ids_of_any_kind(spark, monkeypatch, kind, most_rows):
    """Negative, scattered, repeated, null and unknown ids, broadcast or joined."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", most_rows)
    ids = [-2147483648, -65, -64, -63, -1, 0, 1, 1, 63, 64, 65, 2147483647, None, None]
    docs = spark.createDataFrame([(i, "word") for i in ids], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    good = {-2147483648, -64, 1, 63, 64, 2147483647, 77}
    labels = spark.createDataFrame([(i, int(i in good)) for i in {*ids, 77} - {None}] + [(None, 1), (1, 0)], "doc_id long, quality int")
    labels = labels.withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = quality.flag_trusted(docs, labels).collect()
    assert len(rows) == len(ids)
    assert all(r.trusted == (r.doc_id is not None and int(r.doc_id) in good) for r in rows)


def test_texts_are_not_moved_for_the_flag(spark):
    """Ids beyond Spark's own limit for a broadcast; 20,000 of them take some 300 rows."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'word' AS text")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 20 <> 0 AS INT) AS quality")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        flagged = quality.flag_trusted(docs, labels)
        assert flagged.where("trusted").count() == 19_000
        plan = flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
