from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from greedy import survivors

from feedloom.catalog.base import AS_OF, dated_items
from feedloom.operators import dedup

BASE = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
SCHEMA = "ord long, title string, summary string, link string, published_ts timestamp"


def restated(items):
    """Rows for the sequential pass, keys taken from the column functions."""
    keyed = items.select(
        "ord",
        F.unix_micros(F.coalesce("published_ts", dedup.instant(AS_OF))).alias("at"),
        F.coalesce("link", F.lit("")).alias("link"),
        dedup.normalise_url("link").alias("url"),
        dedup.netloc("link").alias("site"),
        dedup.fingerprint().alias("fp"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )
    return [r.asDict() for r in keyed.collect()]


def kept(items, **options):
    return {r.ord for r in dedup.deduplicate(items, AS_OF, **options).select("ord").collect()}


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, s, link, None if h is None else BASE + dt.timedelta(hours=h)) for i, (t, s, link, h) in enumerate(rows)],
        SCHEMA,
    )


def test_same_rows_as_sequential_pass(spark):
    items = dated_items(spark, SF_DIR)
    assert kept(items) == survivors(restated(items), scope="all")
    assert kept(items, scope="block") == survivors(restated(items))


RULES = [
    # A dropped row's URL may be used again: row 1 repeats row 0's content, row 2 repeats row 1's URL.
    ([("Alpha news", "same words", "http://h/1", 9), ("Alpha news", "same words", "http://h/2", 8),
      ("Other", "different", "http://h/2", 7)], {0, 2}),
    # Equal fingerprint, raw texts too different: both stay.
    ([("<aaaaaaaaaaaaaaaaaaaaaaaaaaaa>Go", "", "http://h/1", 9), ("<zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz>Go", "", "http://h/2", 1)], {0, 1}),
    # Rows without a link always stay.
    ([("Alpha", "x", "", 9), ("Alpha", "x", "", 8), ("Alpha", "x", None, 8)], {0, 1, 2}),
    # Undated rows count as newest.
    ([("Alpha", "x", "http://h/1", 9), ("Beta", "y", "http://h/1", None)], {1}),
    # Tracking keys and fragments do not make a new URL.
    ([("A", "x", "http://h/1?utm_source=z", 9), ("B", "y", "http://h/1#top", 8)], {0}),
    # Rows without title and summary resemble nothing.
    ([("", "", "http://h/1", 9), ("", "", "http://h/2", 8), (None, None, "http://h/3", 7)], {0, 1, 2}),
    # Ties in time: input order decides.
    ([("A", "x", "http://h/1", 5), ("B", "y", "http://h/1", 5)], {0}),
    # Similar titles count within a day only.
    ([("<b>breaking</b> " + "w" * 40, "", "http://h/1", 30), ("<i>breaking</i> " + "w" * 40, "", "http://h/2", 6)], {0}),
    ([("<bbb>x" + "w" * 20, "", "http://h/1", 31), ("<iii>x" + "w" * 20, "", "http://h/2", 6)], {0, 1}),
]


@pytest.mark.parametrize("rows,expected", RULES)
def test_rules(spark, rows, expected):
    items = frame(spark, rows)
    assert survivors(restated(items), scope="all") == expected
    assert kept(items) == expected


def mixed(seed: int, n: int):
    """Few URLs, few fingerprints, titles that differ in markup only: long chains of dependent rows."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        tag = pick.choice(["", "<b>", "<iiiiiiiiiiiiiiiiiiiii>", "<uuuuuuuuuuuuuuuuuuuuuuuu>", "<b><b><b><b><b><b>"])
        title = tag + pick.choice(["go", "stop", "", "a the"])
        summary = pick.choice(["", "text", "<p>text", "<qqqqqqqqqqqqqqqqqqqqq>text"])
        link = pick.choice(["", None] + [f"http://h{pick.randrange(2)}/{i}" for i in range(n // 3)])
        rows.append((title, summary, link, pick.choice([None, 0, 1, 5, 30, 60])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_chains(spark, seed):
    items = frame(spark, mixed(seed, 60))
    rows = restated(items)
    want = survivors(rows)
    assert kept(items, scope="block") == want
    assert kept(items, scope="block", leaders=2 + seed % 3) == want
    assert kept(items) == survivors(rows, scope="all")


def test_match_outside_the_group_cascades(spark):
    """Row 1 falls to row 0, which has another fingerprint; so row 3, which row 1 would block, stays."""
    rows = [
        ("<kkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkk>go", "", "http://other/1", 9),
        ("<kkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkk>go", "", "http://h/1", 8),
        ("go", "", "http://h/2", 9),
        ("something else", "", "http://h/1#again", 1),
    ]
    items = frame(spark, rows)
    assert kept(items, scope="block") == survivors(restated(items)) == {0, 1, 2}
    assert kept(items) == survivors(restated(items), scope="all") == {0, 2, 3}
    matched = {r.ord: r.matched for r in dedup.dropped_rows(items, AS_OF).collect()}
    assert matched == {1: 0}


def test_hot_group_of_distinct_rows(spark):
    """One fingerprint holds every row and no two rows are alike: many leaders, several rounds."""
    rows = [("", f"<{chr(97 + i % 26) * (20 + 3 * i)}>text", f"http://h/{i}", 0) for i in range(40)]
    items = frame(spark, rows)
    assert kept(items, scope="block", leaders=8) == survivors(restated(items))
    assert kept(items) == survivors(restated(items), scope="all")


def test_idempotent_and_unique(spark):
    items = dated_items(spark, SF_DIR)
    once = dedup.deduplicate(items, AS_OF)
    again = dedup.deduplicate(once, AS_OF)
    assert once.count() == again.count()
    linked = once.filter("link <> ''")
    assert linked.select(dedup.normalise_url("link")).distinct().count() == linked.count()
    assert once.filter("link = ''").count() == items.filter("link = ''").count()


@pytest.mark.parametrize("partitions", ["1", "4", "50"])
def test_same_result_for_any_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        items = frame(spark, mixed(99, 80))
        assert kept(items, scope="block") == survivors(restated(items))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_report_and_reasons(spark):
    items = frame(spark, RULES[0][0])
    dropped = dedup.dropped_rows(items, AS_OF)
    assert [tuple(r) for r in dropped.collect()] == [(1, "content", 0)]
    assert dedup.dedup_report(items, dropped).first().asDict() == {
        "input_count": 3, "output_count": 2, "dropped_count": 1,
    }


def test_similarity_is_directed(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "x"), ("Same", "sAME"), (None, "x")], "a string, b string")
    got = [r.similarity for r in dedup.with_similarity(df, "a", "b").collect()]
    assert got[:4] == [0.25, 0.5, 0.0, 1.0] and got[4] == 0.0


def pair(spark, later, kept_row):
    names = [f"{s}_{c} {t}" for s in ("later", "kept") for c, t in (
        ("title", "string"), ("summary", "string"), ("link", "string"), ("published_ts", "timestamp"))]
    df = spark.createDataFrame([(*later, *kept_row)], ", ".join(names))
    return dedup.duplicate_pairs(df).first().is_duplicate


def test_duplicate_decision(spark):
    at = lambda seconds: BASE + dt.timedelta(seconds=seconds)
    title, near = "abcdefghij klmnopqrst", "abcdefghij klmnopq"
    link, other = "http://h/1", "http://other/1"
    assert pair(spark, (near, "", link, at(0)), (title, "", link, at(86400)))
    assert not pair(spark, (near, "", link, at(0)), (title, "", link, at(86401)))
    assert pair(spark, (title, "", link, at(0)), (title, "", other, at(10**8)))
    assert pair(spark, ("a", title, link, at(0)), ("b", near, link, at(10**8)))
    assert not pair(spark, ("a", title, link, at(0)), ("b", near, other, at(10**8)))
    assert not pair(spark, ("", "", link, at(0)), ("", "", link, at(0)))
