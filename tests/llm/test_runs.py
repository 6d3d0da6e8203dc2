"""Periodic runs against the definition, on random texts and on whole tables."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from conftest import SF_DIR
from feedloom.llm import runs
from feedloom.llm.queries import periodic_runs


def by_definition(words, least_words=24, least_periods=3):
    """Every stretch that has a period and can't be extended, if no smaller period holds in it."""
    found = []
    for q in range(1, len(words) // least_periods + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i - start + q
                smaller = any(all(words[t] == words[t + p] for t in range(start, start + length - p)) for p in range(1, q))
                if length >= max(least_words, least_periods * q) and not smaller:
                    found.append((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def of_texts(texts, **limits):
    found, bounds = runs.runs_of(texts, **limits)
    out = [[] for _ in texts]
    for start, length, period in found.tolist():
        i = int(np.searchsorted(bounds, start, side="right")) - 1
        out[i].append((start - int(bounds[i]), length, period))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=60) | st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=13), st.integers(1, 9), st.lists(st.sampled_from([b"a", b"b"]), max_size=8)).map(lambda x: x[2] + x[0] * x[1] + x[2]), max_size=4))
def test_random_texts(texts):
    assert of_texts(texts, least_words=3) == [by_definition(t, 3) for t in texts]
    assert of_texts(texts) == [by_definition(t) for t in texts]


def test_texts_do_not_run_into_each_other():
    assert of_texts([[b"a"] * 23, [b"a"] * 23]) == [[], []]
    assert of_texts([[], [b"a"] * 24, [], [b"a", b"b"] * 20]) == [[], [(0, 24, 1)], [], [(0, 40, 2)]]


def expected(doc_id, text):
    words = (text or "").split()  # the test tables hold no other white space than ASCII
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_definition(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-(r[1] * math.lcm(*[x[2] for x in found])) // r[2], r[0], r[2]), default=(None, None, None))
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2],
        hashed("".join(f"{s},{length},{q}\n" for s, length, q in found)), hashed(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 15
    # The definition takes the square of the words.
    for r in docs:
        if len((r.text or "").split()) <= 700:
            assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_odd_documents(spark, odd_documents, no_documents):
    renamed = odd_documents.withColumnRenamed("n", "runs").withColumnRenamed("ids", "collapsed")
    for docs in (odd_documents, renamed):
        rows = runs.find_runs(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r.doc_id in (3, 4, 5):
                assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
        assert [tuple(x) for x in next(r for r in rows if r.doc_id == 6).runs] == [(0, 20000, 977 * 5)]
    assert runs.find_runs(no_documents).collect() == []


def test_long_text_of_one_word(spark):
    rows = runs.find_runs(spark.createDataFrame([(1, "x " * 400_000)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in rows[0].runs] == [(0, 400_000, 1)] and rows[0].collapsed == "x"


def test_strongest(spark):
    from pyspark.sql import functions as F

    rows = [(1, [(0, 30, 7), (5, 60, 14), (9, 31, 7)]), (2, []), (3, [(4, 24, 2), (1, 24, 2)])]
    df = spark.createDataFrame(rows, f"i int, runs {runs.RUNS}").select("i", runs.strongest(F.col("runs")).alias("b"))
    assert {r.i: r.b and tuple(r.b) for r in df.collect()} == {1: (9, 31, 7), 2: None, 3: (4, 24, 2)}
