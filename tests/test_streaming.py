from __future__ import annotations

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from greedy import survivors
from test_dedup import mixed, restated

from feedloom.catalog.composites import ingested_in_turn
from feedloom.operators.dedup import deduplicate
from feedloom.schema import conform, with_published_ts
from feedloom.streaming import history, ingest

AS_OF = dt.datetime(2024, 1, 16)


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(
        json.dumps({"ord": o, "title": t, "link": link, "published": p}) for o, t, link, p in rows
    ))


def run(spark, landed, root):
    stream = with_published_ts(ingest.item_stream(spark, str(landed), 1))
    ingest.ingest(stream, str(root), AS_OF).awaitTermination()
    return sorted(r.ord for r in ingest.ingested(spark, str(root)).collect())


def test_ingest_over_several_runs(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "out"
    land(landed, "1.json", [
        (0, "a", "http://h/1", "2024-01-01 00:00:00"), (1, "b", "http://h/1?utm_source=x", "2024-01-02 00:00:00"),
        (2, "c", "", "2024-01-02 00:00:00"),
    ])
    assert run(spark, landed, root) == [1, 2]
    land(landed, "2.json", [
        (3, "d", "http://h/1#late", "2024-01-05 00:00:00"), (4, "e", "http://h/4", "2024-01-05 00:00:00"),
        (5, "c", "", "2024-01-02 00:00:00"), (6, "b", "http://h/6", "2024-01-05 00:00:00"),
    ])
    assert run(spark, landed, root) == [1, 2, 4, 5]
    assert run(spark, landed, root) == [1, 2, 4, 5]


def test_replayed_batch_replaces_itself(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "out"
    land(landed, "1.json", [(0, "a", "http://h/1", "2024-01-01 00:00:00")])
    assert run(spark, landed, root) == [0]
    commits = root / "checkpoint" / "commits"
    for mark in [*commits.glob("0"), *commits.glob(".0.crc")]:
        mark.unlink()
    assert run(spark, landed, root) == [0]


def test_a_shared_fingerprint_alone_does_not_block(spark, tmp_path):
    """Two items agree in the first hundred words and differ after them: one pass keeps both, and so do two batches."""
    start = " ".join(f"word{k}" for k in range(120))
    rows = [(1, "", "http://h/1", "2024-01-05 00:00:00", f"{start} {'alpha ' * 400}"), (2, "", "http://h/2", "2024-01-02 00:00:00", f"{start} {'omega ' * 400}")]
    landed, root = tmp_path / "landed", tmp_path / "out"
    for o, t, link, p, summary in rows:
        landed.mkdir(exist_ok=True)
        (landed / f"{o}.json").write_text(json.dumps({"ord": o, "title": t, "link": link, "published": p, "summary": summary}))
        kept = run(spark, landed, root)
    items = with_published_ts(spark.read.schema(ingest.ITEM).json(str(landed)))
    assert kept == sorted(r.ord for r in deduplicate(items, AS_OF).collect()) == [1, 2]


def test_batches_that_arrive_newest_first_equal_one_pass(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "out"
    rows = [(k, f"title {k % 7}", f"http://h{k % 3}/{k % 11}", f"2024-01-{28 - k // 2:02d} 00:00:00") for k in range(40)]
    for n in range(4):
        land(landed, f"{n}.json", rows[n * 10:n * 10 + 10])
        kept = run(spark, landed, root)
    items = with_published_ts(spark.read.schema(ingest.ITEM).json(str(landed)))
    assert kept == sorted(r.ord for r in deduplicate(items, AS_OF).collect())


def land_items(spark, folder, name, rows):
    """``rows``: ord, title, summary, link, published."""
    folder.mkdir(exist_ok=True)
    fields = ("ord", "title", "summary", "link", "published")
    (folder / name).write_text("\n".join(json.dumps(dict(zip(fields, r))) for r in rows))


def test_a_similar_row_of_another_fingerprint_in_an_earlier_batch(spark, tmp_path):
    """Row 1 shares its fingerprint with row 2, which it doesn't resemble, and falls to row 0, which has another; so row 3,
    which it would block, stays."""
    long = "<kkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkk>go"
    batches = [
        [(0, long, "", "http://other/1", "2024-01-09 09:00:00"), (2, "go", "", "http://h/2", "2024-01-09 09:00:00")],
        [(1, long, "", "http://h/1", "2024-01-09 08:00:00")],
        [(3, "something else", "", "http://h/1#again", "2024-01-09 01:00:00")],
    ]
    landed, root = tmp_path / "landed", tmp_path / "out"
    for n, rows in enumerate(batches):
        land_items(spark, landed, f"{n}.json", rows)
        kept = run(spark, landed, root)
    assert kept == [0, 2, 3]


@pytest.mark.parametrize("seed", [0, 1])
def test_random_batches_equal_the_plain_pass(spark, tmp_path, seed):
    """Chains of dependent rows dealt out over batches, whatever their times: a pass over the batches in turn."""
    landed, root = tmp_path / "landed", tmp_path / "out"
    rows = [
        (i, t, s, link, "" if h is None else f"2024-01-{10 + h // 24:02d} {h % 24:02d}:00:00") for i, (t, s, link, h) in enumerate(mixed(seed, 60))
    ]
    turns = {}
    for n in range(3):
        part = rows[n * 20:n * 20 + 20]
        turns |= {r[0]: n for r in part}
        land_items(spark, landed, f"{n}.json", part)
        kept = run(spark, landed, root)
    items = with_published_ts(spark.read.schema(ingest.ITEM).json(str(landed)))
    assert kept == sorted(survivors([{**r, "turn": turns[r["ord"]]} for r in restated(items)], scope="all"))


@pytest.mark.parametrize("seed", [2, 3])
def test_random_batches_that_look_at_few_rows_of_a_url(spark, tmp_path, monkeypatch, seed):
    """One row of each URL, two more, then all: the same as a pass over all rows, however often more have to be looked at."""
    monkeypatch.setattr(ingest, "FIRST_OF_URL", 1)
    monkeypatch.setattr(ingest, "MORE_OF_URL", 2)
    monkeypatch.setattr(ingest, "MOST_OF_URL", 2)
    test_random_batches_equal_the_plain_pass(spark, tmp_path, seed)


def test_rows_that_fall_by_their_url_are_not_fingerprinted(spark, tmp_path, monkeypatch):
    """The newest row of /1 blocks its others. All but the oldest row of /2 repeat it, so that one is kept and blocks the row of
    /3, and the row of /4 that repeats it as well. A later batch of known URLs gets no fingerprints at all."""
    keyed, key_table = [], ingest.key_table
    monkeypatch.setattr(ingest, "key_table", lambda items, *rest: keyed.append(items.count()) or key_table(items, *rest))
    time = lambda n: f"2024-01-09 {23 - n // 60:02d}:{59 - n % 60:02d}:00"
    rows = [(n, "the same title", "", "http://h/1", time(n)) for n in range(300)]
    rows += [(300 + n, "the same title", "", "http://h/2", time(300 + n)) for n in range(70)]
    rows += [(370, "another thing", "", "http://h/2", time(370)), (371, "another thing", "", "http://h/3", time(371)), (372, "the same title", "", "http://h/4", time(372))]
    landed, root = tmp_path / "landed", tmp_path / "out"
    land_items(spark, landed, "0.json", rows)
    assert run(spark, landed, root) == [0, 370]
    assert sum(keyed) <= 4 + 71 + 2
    land_items(spark, landed, "1.json", [(400 + n, f"news {n}", "", f"http://h/{n % 2 + 1}#again", "2024-01-09 01:00:00") for n in range(30)])
    keyed.clear()
    assert run(spark, landed, root) == [0, 370] and sum(keyed) == 0


def test_landing_in_turn_reads_the_items_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda published: seen.add(1) or published)
    published = count(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 15 + 1).cast("string"), 2, "0"), F.lit(" 00:00:00")))
    title = F.concat(F.lit("title "), F.expr("repeat(char(65 + id), 9)"))
    rows = spark.range(30).select(
        F.col("id").alias("ord"), F.concat(F.lit("http://h/"), "id").alias("link"), title.alias("title"), published.alias("published"))
    assert sorted(r.ord for r in ingested_in_turn(spark, conform(with_published_ts(rows))).collect()) == list(range(30))
    assert seen.value == 30


def size_of(folders):
    return sum(f.stat().st_size for _, paths in folders for p in paths for f in pathlib.Path(p).rglob("*.parquet"))


def test_what_a_batch_reads_stays_flat(spark, tmp_path):
    """Lookups of a few keys read a few folders, however many rows are kept; segments stay few."""
    probe = spark.createDataFrame([(f"key-{i * 1000}",) for i in range(4)], "url string")
    read, kept, segments = [], [], []
    for n in range(20):
        tables = history.History(spark, str(tmp_path), n, bucket_rows=50)
        rows = spark.createDataFrame([(f"key-{n * 1000 + i}",) for i in range(1000)], "url string")
        tables.add("urls", rows.coalesce(1), "url")
        tables.commit()
        now = history.History(spark, str(tmp_path))
        read.append(size_of(now.folders("urls", probe, "url")))
        kept.append(size_of(now.folders("urls")))
        segments.append(len(now.segments("urls")))
    found = history.History(spark, str(tmp_path)).read("urls", ingest._URLS, probe, "url")
    assert found.join(probe, "url", "left_semi").count() == 4
    assert history.History(spark, str(tmp_path)).read("urls", ingest._URLS).distinct().count() == 20_000
    # A segment is read in at most as many folders as there are keys.
    assert max(segments) <= 9 and max(read) <= 4 * 9 * 3000 and read[-1] < 0.25 * kept[-1]
    assert len(list((tmp_path / "urls").iterdir())) <= max(segments) + 9


def test_stream_dedup_within_watermark(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "out"
    land(landed, "1.json", [
        (0, "a", "http://h/1", "2024-01-01 00:00:00"), (1, "a", "http://h/1#x", "2024-01-01 01:00:00"),
        (2, "a", "http://h/2", "2024-01-01 01:00:00"), (3, "a", "", "2024-01-01 01:00:00"), (4, "a", "http://h/9", ""),
    ])
    items = with_published_ts(ingest.item_stream(spark, str(landed)))
    ingest.run_to_folder(ingest.dedup_stream(items), str(root)).awaitTermination()
    got = spark.read.parquet(f"{root}/rows")
    assert sorted((r.norm_url or "") for r in got.collect()) == ["", "", "http://h/1", "http://h/2"]
    prints = tmp_path / "prints"
    ingest.run_to_folder(ingest.dedup_stream_by_fingerprint(items), str(prints)).awaitTermination()
    assert spark.read.parquet(f"{prints}/rows").count() == 3


def test_newest_row_of_a_window_wins(spark, tmp_path):
    """A row that arrives later and is newer wins, so does one that arrived before an older one; a day apart is another session."""
    landed, root = tmp_path / "landed", tmp_path / "out"
    batches = [
        [(0, "a", "http://h/1", "2024-01-01 10:00:00"), (1, "b", "http://h/2", "2024-01-01 12:00:00"), (2, "c", "", "2024-01-01 01:00:00"), (3, "d", "http://h/9", "")],
        [(4, "a", "http://h/1#x", "2024-01-01 20:00:00"), (5, "b", "http://h/2?utm_source=x", "2024-01-01 09:00:00"), (6, "b", "http://h/2", "2024-01-01 12:00:00")],
        [(7, "a", "http://h/1", "2024-01-04 00:00:00")],
        [(8, "z", "http://h/z", "2030-01-01 00:00:00")],
    ]
    for n, rows in enumerate(batches):
        land(landed, f"{n}.json", rows)
        items = with_published_ts(ingest.item_stream(spark, str(landed)))
        ingest.run_to_folder(ingest.dedup_stream_newest(items), str(root)).awaitTermination()
    got = {(r.norm_url, r.ord) for r in spark.read.parquet(f"{root}/rows").collect()}
    assert got == {("http://h/1", 4), ("http://h/2", 1), ("http://h/1", 7), (None, 2), (None, 3)}
