"""Queries of the corpus operators against their SQL, and those without SQL run whole."""

from __future__ import annotations

import pytest

import compare
from feedloom.llm.registry import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


def test_names():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert sorted(ORACLES) == ["op12_fill_in_middle", "op13_quality_rules", "op6_license_scan", "op7_warc", "op9_mix_sources"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), compare.connect(SF_DIR), ORACLES[name]) is None
