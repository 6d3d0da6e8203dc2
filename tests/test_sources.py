from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.functions.html import posts_of, PROFILE_POSTS
from feedloom.operators.dedup import dedup_job
from feedloom.schema import ITEM, conform
from feedloom.sources import config, feeds, profiles, repos, storage, videos
from feedloom.plans import curation

AS_OF = dt.datetime(2024, 1, 16)

RSS = """<?xml version="1.0"?><rss><channel><title>C</title>
<item><title> First &amp; best </title><link>http://h/1</link><description>d1</description><guid>g1</guid>
<pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><author>Ann</author></item>
<item><title>Second</title><link>ftp://h/2</link><description>d2</description></item>
<item><link>http://h/3</link><description>d3</description><pubDate>someday</pubDate></item>
</channel></rss>"""


def test_rss_documents(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    entries = feeds.read_rss(spark, str(tmp_path)).withColumns(
        {"source_name": F.lit("S"), "source_category": F.lit(None).cast("string")}
    )
    rows = feeds.normalise_entries(entries, AS_OF).orderBy("ord").collect()
    assert [(r.id, r.title, r.summary, r.published, r.author, r.category) for r in rows] == [
        ("g1", "First & best", "d1", "2024-01-02T10:00:00", "Ann", "uncategorized"),
        ("http://h/3", "No title", "d3", "someday", "Unknown", "uncategorized"),
    ]


def test_configuration(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({
        "rss_feeds": [
            {"name": "ok", "url": "https://h/f", "category": "c"}, {"name": "", "url": "https://h/f", "category": "c"},
            {"name": "x", "url": "ftp://h", "category": "c"}, {"name": "n" * 101, "url": "http://h", "category": "c"},
            {"name": "x", "url": "http://h"},
        ],
        "github_repositories": [{"name": "r", "owner": "o", "repo": "p", "category": "c"}],
    }))
    document = config.read_config(spark, str(path))
    assert [r.name for r in config.valid_feeds(config.section(document, "rss_feeds")).collect()] == ["ok"]
    assert config.section(document, "github_repositories").first().repo == "p"
    assert config.section(document, "youtube_channels").count() == 0


def landed(spark, schema, *rows):
    lines = [json.dumps({"ord": i, "repo_name": "R", "category": "c", **row}) for i, row in enumerate(rows)]
    df = spark.createDataFrame([(line,) for line in lines], "v string")
    return df.select(F.from_json("v", schema).alias("p")).select("p.*")


def test_releases(spark):
    rows = repos.releases(landed(
        spark, repos.RELEASE,
        {"id": 1, "name": "One", "tag_name": "v1", "html_url": "u", "body": None, "published_at": "2024-01-02T00:00:00Z", "author": {"login": "ann"}},
        {"id": 2, "name": None, "tag_name": "v2", "html_url": "u", "published_at": "2024-01-02T00:00:00Z", "author": None},
        {"id": 3, "name": "draft", "draft": True, "published_at": "2024-01-02T00:00:00Z"},
        {"id": 4, "name": "undated"},
    ), AS_OF).orderBy("ord").collect()
    assert [(r.id, r.title, r.author, r.summary, r.source) for r in rows] == [
        ("github-release-1", "Release One", "ann", "", "GitHub - R"),
        ("github-release-2", "Release v2", "Unknown", "", "GitHub - R"),
    ]


def test_pull_requests_and_issues(spark):
    new, old = "2024-01-10T00:00:00Z", "2024-01-08T23:59:59Z"
    both = [
        {"id": 1, "title": "a", "state": "closed", "merged_at": new, "updated_at": new, "created_at": old},
        {"id": 2, "title": "b", "updated_at": "2024-01-09T00:00:00Z", "created_at": old},
        {"id": 3, "title": "c", "state": "open", "updated_at": old, "created_at": old},
        {"id": 4, "title": "d", "state": "open", "updated_at": new},
    ]
    pulls = repos.pull_requests(landed(spark, repos.PULL_REQUEST, *both), AS_OF).orderBy("ord").collect()
    assert [r.title for r in pulls] == ["PR: a (merged)", "PR: b (open)"] and pulls[0].published == old
    issues = repos.issues(landed(
        spark, repos.ISSUE, {**both[0]}, {**both[0], "pull_request": {"url": "x"}}, both[2]), AS_OF).collect()
    assert [r.title for r in issues] == ["Issue: a (closed)"]


def test_commits(spark):
    commit = lambda message, date, login=None: {
        "sha": "s", "html_url": "u", "author": {"login": login} if login else None,
        "commit": {"message": message, "author": {"date": date, "name": "Ann"} if date else None},
    }
    rows = repos.commits(landed(
        spark, repos.COMMIT, commit("x" * 61 + "\nbody", "2024-01-14T00:00:00Z"), commit("fix", "2024-01-13T00:00:00Z", "bob"),
        commit("old", "2024-01-12T23:59:59Z"), commit("undated", None)), AS_OF).orderBy("ord").collect()
    assert [(r.title, r.author) for r in rows] == [("Commit: " + "x" * 60 + "...", "Ann"), ("Commit: fix", "bob")]


def test_repository_order(spark):
    make = lambda i, source, ts: (i, source, "k", dt.datetime(2024, 1, ts, tzinfo=dt.timezone.utc))
    df = spark.createDataFrame(
        [make(0, "b", 1), make(1, "a", 1), make(2, "a", 5), make(3, "b", 9)],
        "ord long, source string, content_type string, published_ts timestamp")
    wanted = spark.createDataFrame([("b", 0), ("a", 1)], "source string, source_ord int")
    assert [r.ord for r in repos.repository_activity([df], wanted).collect()] == [3, 0, 2, 1]
    assert [r.ord for r in repos.repository_activity([df.limit(0), df]).collect()] == [2, 1, 3, 0]


def test_videos(spark):
    schema = ("ord long, channel_name string, category string, snippet struct<title:string, description:string, "
              "publishedAt:string, resourceId:struct<videoId:string>, thumbnails:struct<high:struct<url:string>>>")
    snippet = lambda vid, at: ("t", None, at, (vid,), None)
    rows = [(i, "C", None, snippet(f"v{i}", "2024-01-10T00:00:00Z")) for i in range(12)]
    rows[1] = (1, "C", None, snippet(None, None))
    rows[2] = (2, "C", None, snippet("v2", "2023-12-16T23:59:59Z"))
    rows[3] = (3, "C", None, snippet("v3", None))
    got = videos.channel_videos(spark.createDataFrame(rows, schema), AS_OF).orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 3, 4, 5, 6, 7, 8, 9]
    assert (got[0].source, got[0].category, got[0].summary) == ("YouTube - C", "YouTube", "No description")


PAGE = """<div class="feed-shared-update-v2 x"><div class="feed-shared-text"> Hello <b>there</b> </div>
<a class="app-aware-link" href="/posts/1">l</a><span class="feed-shared-actor__sub-description">2d</span></div>
<div class="feed-shared-update-v2"><div class="feed-shared-text"></div></div>
<div class="feed-shared-update-v2"><span class="feed-shared-article__title">""" + "T" * 101 + """</span></div>
<div class="feed-shared-card"><div class="feed-shared-text">other layout</div></div>"""


def test_profile_page(spark):
    pages = spark.createDataFrame([("Ann", "http://p", None, PAGE), ("Bob", "http://q", "c", None)],
                                  "name string, url string, category string, html string")
    rows = profiles.profile_posts(pages, AS_OF).orderBy("page_pos").collect()
    assert [(r.id, r.link, r.title, r.published, r.category) for r in rows] == [
        ("https://www.linkedin.com/posts/1", "https://www.linkedin.com/posts/1", "Hellothere", "2024-01-14T00:00:00Z", "linkedin"),
        ("linkedin-Ann-1", "http://p", "T" * 100 + "...", "2024-01-16T00:00:00Z", "linkedin"),
    ]


def test_first_container_layout_wins():
    page = '<div class="occludable-update ember-view"><div class="feed-shared-text">a</div></div>' + PAGE
    assert [p["content"] for p in posts_of(page, PROFILE_POSTS)] == ["a"]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_snapshots(spark, tmp_path, fmt):
    root = str(tmp_path / "runs")
    assert storage.latest_snapshot(spark, root, fmt).count() == 0
    items = conform(spark.createDataFrame([(1, "a"), (2, "b")], "ord long, title string"))
    storage.save_items(items, root, "20240101_000000", fmt)
    storage.save_items(items.filter("ord = 2"), root, "20240102_000000", fmt)
    assert [r.title for r in storage.latest_snapshot(spark, root, fmt).collect()] == ["b"]
    assert storage.load_snapshots(spark, root, fmt).groupBy("run_ts").count().count() == 2
    storage.save_items(items, root, "20240102_000000", fmt)
    assert storage.latest_snapshot(spark, root, fmt).count() == 2


def test_load_items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps([{"ord": 1, "title": "x", "unknown": 5}, {"ord": 2}]))
    assert [r.title for r in storage.load_items(spark, str(path)).orderBy("ord").collect()] == ["x", None]
    assert storage.load_items(spark, str(tmp_path / "absent.json")).schema == ITEM
    (tmp_path / "bad.json").write_text("{not json")
    assert storage.load_items(spark, str(tmp_path / "bad.json")).count() == 0


def test_folder_of_both_layouts(spark, tmp_path):
    """Line-delimited files, arrays and indented objects in one folder, with blanks in their names."""
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a b.json").write_text('\n {"ord": 0, "title": "a"}\n{"ord": 1, "title": "b"}\n')
    (folder / "b.json").write_text(json.dumps([{"ord": 2, "title": "c"}, {"ord": 3, "title": "d"}], indent=1))
    (folder / "c%20d.json").write_text(json.dumps({"ord": 4, "title": "e"}, indent=1))
    (folder / "d.json").write_text("\n\n")
    (folder / "e[1].json").write_text('[{"title": "f"}]')
    assert sorted(r.title for r in storage.load_items(spark, str(folder)).collect()) == list("abcdef")
    assert [(r.ord, r.title) for r in storage.load_ordered_items(spark, str(folder)).orderBy("ord").collect()] == list(enumerate("abcdef"))
    assert dedup_job(spark, str(folder), str(tmp_path / "out"), AS_OF).first().input_count == 6
    (folder / "f.json").write_text('{"ord": 6, "title": "g"}\n{broken\n')
    assert storage.load_items(spark, str(folder)).count() == 7
    with pytest.raises(Exception, match="unreadable record in .*f.json"):
        dedup_job(spark, str(folder), str(tmp_path / "other"), AS_OF)
    with pytest.raises(Exception, match="unreadable record in .*f.json"):
        curation.ad_hoc(spark, {}, AS_OF, curation.Options(load=str(folder)))["items"].collect()


def test_stage_and_dedup_job(spark, tmp_path):
    source, target = str(tmp_path / "in.json"), str(tmp_path / "out")
    (tmp_path / "in.json").write_text(json.dumps([
        {"ord": 0, "title": "a", "link": "http://h/1", "published": "2024-01-01 00:00:00"},
        {"ord": 1, "title": "b", "link": "http://h/1#x", "published": "2024-01-02 00:00:00"},
    ]))
    report = dedup_job(spark, source, target, AS_OF, multi_line=True).first()
    assert (report.input_count, report.output_count) == (2, 1)
    assert [r.ord for r in spark.read.json(target).collect()] == [1]
    uri = storage.store_stage(spark.range(3), str(tmp_path), "filtered", "r1")
    assert storage.retrieve_stage(spark, uri).count() == 3


def test_digest_file(spark, tmp_path):
    storage.save_digest(spark.createDataFrame([("<p>\nx",)], "digest string"), str(tmp_path / "d"))
    parts = list((tmp_path / "d").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text() == "<p>\nx\n"


@pytest.mark.parametrize("bad", [{"days": 0}, {"days": 366}, {"max_items": 101}, {"batch_size": 51}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        curation.Options(**bad)


def test_a_job_that_fails_while_writing_leaves_the_old_result(spark, tmp_path):
    root = str(tmp_path / "runs")
    items = conform(spark.createDataFrame([(1, "a"), (2, "b")], "ord long, title string"))
    storage.save_items(items, root, "20240101_000000")
    broken = items.withColumn("title", F.when(F.col("ord") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        storage.save_items(broken, root, "20240101_000000")
    assert [r.title for r in storage.latest_snapshot(spark, root).orderBy("ord").collect()] == ["a", "b"]
    assert os.listdir(root) == ["run_ts=20240101_000000"]
