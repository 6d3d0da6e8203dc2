"""Every registered query against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import compare
import greedy
from conftest import SF_DIR

import __spark_entry__ as entry_point
from feedloom.catalog.base import dated_items
from feedloom.catalog.registry import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_registry():
    assert ORACLES.keys() <= QUERIES.keys()
    assert sorted(QUERIES.keys() - ORACLES.keys()) == ["d05_duplicate_pairs", "d06_similar_titles", "d06_similarity"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_similar_pairs(spark):
    """Both queries on pairs, which SQL can't state, against the plain rule on tables with repeated URLs."""
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    site = F.regexp_extract(F.coalesce("link", F.lit("")), "^[^:/?#]+://([^/?#]*)", 1)
    rows = dated_items(spark, folder).select(
        "ord", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"),
        site.alias("site"), F.unix_micros("published_ts").alias("at"),
    )
    items = {r.ord: {**r.asDict(), "at": r.at if r.at is not None else math.inf} for r in rows.collect()}
    pairs = QUERIES["d05_duplicate_pairs"](spark, folder).collect()
    assert len(pairs) > 50
    for p in pairs:
        later, kept = items[p.later_ord], items[p.kept_ord]
        dated = math.isfinite(later["at"]) and math.isfinite(kept["at"])
        if not dated:  # no time, no closeness
            later, kept = {**later, "at": 0}, {**kept, "at": 0}
        assert p.is_duplicate == greedy.is_duplicate(later, kept, hours=24 if dated else -1)
    ratios = QUERIES["d06_similarity"](spark, folder).collect()
    assert {(p.later_ord, p.kept_ord) for p in ratios} == {(p.later_ord, p.kept_ord) for p in pairs}
    for p in ratios:
        sides = items[p.later_ord]["title"].lower(), items[p.kept_ord]["title"].lower()
        assert p.similarity == pytest.approx(greedy.alike(*sides))
        sides = items[p.later_ord]["summary"].lower(), items[p.kept_ord]["summary"].lower()
        assert p.summary_similarity == pytest.approx(greedy.alike(*sides))


def test_similar_titles(spark):
    """The similarity join against every pair."""
    titles = {r.ord: (r.title or "").lower() for r in dated_items(spark, SF_DIR).select("ord", "title").collect()}
    want = {}
    for later, a in titles.items():
        for kept, b in titles.items():
            if kept < later and a and b and SequenceMatcher(None, a, b).real_quick_ratio() >= 0.95 and (ratio := greedy.alike(a, b)) >= 0.95:
                want[later, kept] = ratio
    rows = QUERIES["d06_similar_titles"](spark, SF_DIR).collect()
    listed = {(r.later_ord, r.kept_ord): r.similarity for r in rows}
    first = {}
    for ord_, title in sorted(titles.items()):
        first.setdefault(title, ord_)
    # A row for each copy, and otherwise only rows that stand for a title.
    assert len(rows) == len(listed)
    assert all(p in listed for p in ((o, first[t]) for o, t in titles.items() if t and first[t] != o))
    assert all(first[titles[a]] == b or (first[titles[a]], first[titles[b]]) == (a, b) for a, b in listed)
    got = {}
    for later, a in titles.items():
        for kept, b in titles.items():
            if kept < later and a and b and (a == b or (first[a], first[b]) in listed):
                got[later, kept] = 1.0 if a == b else listed[first[a], first[b]]
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
