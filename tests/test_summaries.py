from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedloom.functions.text import content_hash
from feedloom.operators import summaries
from feedloom.operators.joins import cache_hits, cache_misses
from feedloom.session import stage
from feedloom.sources import cache

FIELDS = "ord long, batch_index long, summary string, ai_summary string, generated_summary string, " \
         "description string, relevance_score double, link string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, i // 3, s, None, g, "d" * 60, None, link) for i, (s, g, link) in enumerate(rows)], FIELDS)


LONG = "word " * 40


@pytest.fixture
def items(spark):
    return frame(
        spark, (LONG, None, "http://a"), ("", None, "http://b"), (LONG, "done", "http://c"),
        (LONG, None, "http://d"), (LONG, None, "http://e"), (LONG, None, "http://f"),
    )


def results(df):
    return [r.generated_summary for r in df.orderBy("ord").collect()]


def test_default_summary_and_gate(items):
    """Row 1 opens the first batch; nobody in the second needs a summary."""
    got = results(summaries.batch_summarise(items))
    assert got == [LONG[:150] + "...", None, "done", None, None, None]


def test_whole_gate(items):
    """One needy row opens everything; without it nothing is touched."""
    got = results(summaries.batch_summarise(items, gate="whole"))
    assert got == [LONG[:150] + "...", None, "done"] + [LONG[:150] + "..."] * 3
    closed = results(summaries.batch_summarise(items.filter("ord <> 1"), gate="whole"))
    assert closed == [None, "done", None, None, None]


def test_callable_sees_each_text_once(spark, items, tmp_path):
    log = str(tmp_path / "calls")

    def summarise(texts):
        with open(log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return [t[:4].upper() for t in texts]

    twice = frame(spark, (LONG, None, ""), ("", None, "http://b"), (LONG, None, ""))
    assert results(summaries.batch_summarise(twice, summarise)) == ["WORD", None, "WORD"]
    assert len(open(log).readlines()) == 1


def test_cache_and_pages(spark, items):
    cache = items.limit(1).select(content_hash("summary").alias("hash"), F.lit("cached").alias("summary"))
    page = spark.createDataFrame([("http://b", "page " * 40), ("http://b", "page " * 40)], "link string, text string")
    got = summaries.batch_summarise(items, lambda texts: [t[:4] for t in texts], cache, page)
    assert results(got)[:3] == ["cached", "page", "done"]
    assert got.count() == 6


def test_failure_keeps_rows(items):
    def broken(texts):
        raise RuntimeError("no model")

    got = summaries.batch_summarise(items, broken)
    assert results(got)[0] == LONG[:150] + "..."
    assert got.orderBy("ord").first().summary_error == "RuntimeError: no model"


def test_short_result_is_an_error(items):
    got = summaries.batch_summarise(items, lambda texts: [])
    assert got.orderBy("ord").first().summary_error.startswith("ValueError")


def test_publish_and_cache_rows(spark, items):
    done = summaries.publish_summaries(summaries.batch_summarise(items))
    assert [r.ai_summary for r in done.orderBy("ord").collect()][:3] == [LONG[:150] + "...", None, "done"]
    fresh = summaries.fresh_cache_rows(done, 7).collect()
    assert len(fresh) == 1 and fresh[0].version == 7


def test_cache_round_trip_by_content_and_by_link(spark):
    """Two rows with blank content keep their pages' summaries apart, and a row with neither gets none."""
    rows = frame(spark, (LONG, None, ""), ("", None, "http://b"), ("", None, "http://c"), ("", None, ""))
    pages = spark.createDataFrame([("http://b", "first " * 40), ("http://c", "second " * 40)], "link string, text string")
    done = summaries.batch_summarise(rows, lambda texts: [t[:5] for t in texts], pages=pages)
    cache = summaries.fresh_cache_rows(done, 1).select("hash", F.col("summary").alias("cached"))
    hits = cache_hits(rows, cache, "summary", "link").orderBy("ord").collect()
    assert [r.cached for r in hits] == [LONG[:5], "first", "secon", None] and hits[3].hash is None
    assert [r.ord for r in cache_misses(rows, cache, "summary", "link").collect()] == [hits[3].ord]


def test_calls_survive_a_failed_job(spark, tmp_path):
    """A worker that dies loses the calls of its wave only; the next run calls for what the log lacks."""
    rows = frame(spark, *[(f"text {i} " * 30, None, "") for i in range(24)], ("", None, "http://b"))
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")

    def summarise(texts, deadly=None):
        if deadly is not None and any(t.startswith(deadly) for t in texts):
            raise SystemExit(1)
        with open(calls, "a") as out:
            out.writelines(f"{t.split()[1]}\n" for t in texts)
        return [t[:7].upper() for t in texts]

    wave = F.pmod(F.xxhash64(content_hash("summary")), F.lit(6))
    last = rows.filter("ord < 24").select("ord", wave.alias("wave")).orderBy(F.desc("wave"), "ord").first().ord
    with pytest.raises(Exception):
        summaries.batch_summarise(rows, lambda texts: summarise(texts, f"text {last} "), gate="whole", rows_per_call=1, log=log, waves=6)
    logged = spark.read.parquet(log).select("hash").collect()
    assert 0 < len(logged) < 24
    open(calls, "w").close()
    done = results(summaries.batch_summarise(rows, summarise, gate="whole", rows_per_call=1, log=log, waves=6))
    assert done[:24] == [f"TEXT {i} "[:7] for i in range(24)]
    called = open(calls).read().split()
    assert str(last) in called and len(called) == len(set(called)) == 24 - len(logged)
    open(calls, "w").close()
    summaries.batch_summarise(rows, summarise, gate="whole", log=log).collect()
    assert open(calls).read() == ""


def test_a_failed_list_is_called_again(spark, tmp_path):
    rows = frame(spark, (LONG, None, ""), ("", None, "http://b"))
    log = str(tmp_path / "log")

    def failing(texts):
        raise ValueError("no")

    first = summaries.batch_summarise(rows, failing, log=log).orderBy("ord").first()
    assert first.summary_error == "ValueError: no"
    again = summaries.batch_summarise(rows, lambda texts: ["made"] * len(texts), log=log).orderBy("ord").first()
    assert (again.generated_summary, again.summary_error) == ("made", None)


def test_a_write_touches_only_its_folders(spark, tmp_path):
    root = str(tmp_path / "cache")
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    rows = lambda *r: spark.createDataFrame(r, "hash string, summary string, version long")
    assert cache.read_cache(spark, root).count() == 0
    cache.write_cache(root, rows(*[(f"h{i}", f"s{i}", 1) for i in range(60)]))
    before = files()
    assert cache.write_cache(root, rows(("h3", "new", 2), ("h4", "old", 0), ("h5", "s5", 1))) == 1
    after = files()
    assert len(before.items() - after.items()) == 1
    assert cache.write_cache(root, rows(("h3", "new", 2))) == 0 and files() == after
    kept = {r["hash"]: (r["summary"], r["version"]) for r in cache.read_cache(spark, root).collect()}
    assert kept == {f"h{i}": ("new", 2) if i == 3 else (f"s{i}", 1) for i in range(60)}
    assert {r["hash"] for r in cache.read_cache(spark, root, rows(("h7", "", 0))).collect()} >= {"h7"}


def test_content_does_not_travel_with_the_batches(items):
    """What the summary takes of the content is worked out before the shuffle by batch."""
    done = summaries.batch_summarise(items).select("ord", "generated_summary")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" in plan and "substring(" not in plan[:plan.index("Window")]


def test_logged_texts_are_worked_out_once(items, tmp_path, monkeypatch):
    """The waves and the look-up in the log read the hashes from a table; before, the latter worked out all batches again."""
    staged = []
    monkeypatch.setattr(summaries, "stage", lambda df, name: (staged.append((name, df._jdf.queryExecution().optimizedPlan().toString())), stage(df, name))[1])
    for made in ("first", "second"):
        summaries.batch_summarise(items, lambda texts: [made] * len(texts), log=str(tmp_path / "log"), waves=2).collect()
    assert [n for n, plan in staged if "Window" in plan] == ["summary-work", "summary-work"]
