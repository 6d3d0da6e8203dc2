from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR

from feedloom.catalog.base import AS_OF, dated_items
from feedloom.functions.scoring import with_relevance
from feedloom.operators import filters, joins, ranking, stats, unions

UTC = dt.timezone.utc
ITEMS = "ord long, title string, summary string, link string, category string, published_ts timestamp"


def ords(df):
    return [r.ord for r in df.select("ord").orderBy("ord").collect()]


@pytest.fixture
def items(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h, tzinfo=UTC)
    return spark.createDataFrame(
        [
            (0, "Alpha", None, "http://h/0", "news", at(14)),
            (1, None, "about ALPHA", "ftp://h/1", "News", at(13, 23)),
            (2, "", "x", "https://h/2", None, None),
            (3, "beta", "x", "", "news", at(20)),
        ],
        ITEMS,
    )


def test_filters(items):
    assert ords(filters.by_category(items, "news")) == [0, 3]
    assert ords(filters.recent(items, AS_OF, 2)) == [0, 3]
    assert ords(filters.recent_capped(items, AS_OF, 300)) == [0, 3]
    assert ords(filters.maybe_recent(items, AS_OF, 2)) == [0, 2, 3]
    assert ords(filters.search(items, "aLPHa")) == [0, 1]
    assert ords(filters.valid_items(items)) == [0]


def test_summary_gates(spark):
    fields = "ord long, batch_index long, summary string, ai_summary string, generated_summary string, " \
             "description string, relevance_score double, link string"
    df = spark.createDataFrame(
        [
            (0, 0, "", None, None, "d" * 50, None, "http://h"),
            (1, 0, "s" * 100, None, None, None, None, ""),
            (2, 1, None, None, None, "d" * 49, None, "http://h"),
            (3, 1, None, None, "done", "d" * 200, 0.05, "http://h"),
            (4, 2, None, None, "", "d" * 200, 0.3, None),
            (5, 2, None, "x", None, "d" * 200, 0.9, "http://h"),
        ],
        fields,
    )
    flags = lambda c: [r[0] for r in df.orderBy("ord").select(c).collect()]
    assert flags(filters.needs_summary()) == [True, False, False, False, True, False]
    assert flags(filters.needs_summary_strict()) == [False, False, False, False, True, True]
    assert flags(filters.summary_route()) == ["url", "content", "url", None, None, "url"]
    gated = filters.batch_gate(df, filters.needs_summary())
    assert [r.eligible for r in gated.orderBy("ord").collect()] == [True, True, False, False, True, True]
    alone = filters.batch_gate(df, filters.needs_summary(), gate="row")
    assert [r.eligible for r in alone.orderBy("ord").collect()] == [True, False, False, False, True, False]


@pytest.mark.parametrize("n", [0, 1, 10, 11, 25])
def test_batches_cover_rows_contiguously(spark, n):
    df = spark.range(n).select((F.col("id") * 3 + 7).alias("ord")).orderBy(F.col("ord").desc())
    batched = ranking.assign_batches(df, 10)
    rows = batched.orderBy("ord").collect()
    assert [r.pos for r in rows] == list(range(n))
    assert [r.batch_index for r in rows] == [i // 10 for i in range(n)]
    totals = stats.batch_totals(batched).first()
    assert (totals.num_batches, totals.total_items) == (-(-n // 10), n)
    described = stats.batch_descriptors(batched, 10).orderBy("batch_index").collect()
    assert [(d.batch_start, d.batch_end) for d in described] == [(s, min(s + 10, n)) for s in range(0, n, 10)]


def test_dense_positions_over_many_partitions(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 100000).alias("k"), "id").repartition(13)
    got = [r.id for r in ranking.dense_positions(df, ["k", "id"]).orderBy("pos").collect()]
    assert got == [r.id for r in df.orderBy("k", "id").collect()]


def test_top_per_category_properties(spark):
    items = dated_items(spark, SF_DIR)
    top = ranking.top_per_category(items, 3)
    assert max(r["count"] for r in top.groupBy("category").count().collect()) <= 3
    assert top.join(items, "ord", "left_anti").count() == 0
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_organised_order(items):
    rows = ranking.organise_by_category(items).select("ord", "category").collect()
    assert [(r.ord, r.category) for r in rows] == [(3, "news"), (0, "news"), (1, "News"), (2, "uncategorized")]
    assert [r.ord for r in ranking.sort_newest(items).collect()] == [3, 0, 1, 2]


def test_scores_in_range_and_top(spark):
    scored = with_relevance(dated_items(spark, SF_DIR))
    low, high = scored.agg(F.min("relevance_score"), F.max("relevance_score")).first()
    assert 0 <= low <= high <= 100
    assert "TakeOrderedAndProject" in ranking.top_relevant(scored, 5)._jdf.queryExecution().executedPlan().toString()
    assert filters.relevant(scored).count() + filters.not_relevant(scored).count() == scored.count()


def test_preview(items):
    assert ords(ranking.preview(items.withColumn("source", F.lit("s")), 2)) == [0, 1]
    assert ranking.remaining(items, 2).first().more == 2
    assert ranking.remaining(items, 9).first().more == 0


def test_counts(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, None), (4, "a")], "ord long, source string")
    assert [tuple(r) for r in stats.count_by_source(df).collect()] == [("Unknown", 2, 1), ("a", 2, 2), ("b", 1, 0)]
    configured = spark.createDataFrame([("a",), ("z",)], "source string")
    got = {r.source: r["items"] for r in joins.count_per_source(configured, df).collect()}
    assert got == {"a": 2, "z": 0}


def test_channel_preview(spark):
    df = spark.createDataFrame([(i, "c" if i < 5 else "d", f"t{i}") for i in range(6)], "ord long, source string, title string")
    got = {r.source: (r["items"], r.titles, r.more) for r in stats.channel_preview(df).collect()}
    assert got == {"c": (5, ["t0", "t1", "t2"], 2), "d": (1, ["t5"], 0)}


def test_merge_summaries(spark):
    items = spark.createDataFrame([(0, "a", None), (1, "b", None), (2, None, "g")], "ord long, ai_summary string, generated_summary string")
    new = spark.createDataFrame([(0, "A", ""), (2, "", "G"), (9, "x", "x")], items.schema)
    got = [tuple(r) for r in joins.merge_summaries(items, new).select("ord", "ai_summary", "generated_summary").orderBy("ord").collect()]
    assert got == [(0, "A", None), (1, "b", None), (2, None, "G")]


def test_cache(spark):
    cache = spark.createDataFrame([("h1", "old", 1), ("h2", "keep", 1)], "hash string, summary string, version long")
    fresh = spark.createDataFrame([("h1", "new", 2), ("h3", "first", 2)], cache.schema)
    got = {r.hash: r.summary for r in joins.cache_upsert(cache, fresh).collect()}
    assert got == {"h1": "new", "h2": "keep", "h3": "first"}


def test_union_keeps_order_and_skips_sources(spark):
    a = spark.createDataFrame([(0, "x")], "ord long, title string")
    b = spark.createDataFrame([(0, "http://h")], "ord long, link string")
    both = unions.rank_order(unions.union_sources({"rss": b, "github": a}))
    assert [(r.origin, r.title, r.link) for r in both.orderBy("ord").collect()] == [("rss", None, "http://h"), ("github", "x", None)]
    assert both.select("ord").distinct().count() == 2
    only = unions.union_sources({"rss": b, "github": a}, ("github",))
    assert [r.origin for r in only.collect()] == ["github"]


def test_fetch_and_filter_stats(spark):
    df = spark.createDataFrame([("rss",), ("rss",), ("youtube",)], "origin string")
    assert stats.fetch_stats(df).first().asDict() == {
        "rss_count": 2, "github_count": 0, "youtube_count": 1, "total_items": 3,
    }
    assert tuple(stats.filter_stats(df, F.col("origin") == "rss").first()) == (3, 2)


def test_repeated_keys_do_not_multiply_rows(spark):
    videos = spark.createDataFrame([("a", "x"), ("b", "y")], "video_id string, title string")
    statistics = spark.createDataFrame([("a", "5", "1", None), ("a", "7", None, "2")], "video_id string, views string, likes string, comments string")
    got = joins.with_video_statistics(videos, statistics).orderBy("video_id").collect()
    assert [tuple(r) for r in got] == [("a", "x", "7", "0", "2"), ("b", "y", None, None, None)]
    items = spark.createDataFrame([(0, None, None), (1, "old", None)], "ord long, ai_summary string, generated_summary string")
    new = spark.createDataFrame([(0, "s", ""), (0, "", "g"), (1, "", "")], "ord long, ai_summary string, generated_summary string")
    assert [tuple(r) for r in joins.merge_summaries(items, new).orderBy("ord").collect()] == [(0, "s", "g"), (1, "old", None)]


def test_positions_move_rows_once(spark):
    """The range sort is the only shuffle of the rows; a partition's offset is sent to them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = ranking.dense_positions(spark.range(1000).selectExpr("id * 7 AS ord"))
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r.pos for r in placed.orderBy("ord").collect()] == list(range(1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
