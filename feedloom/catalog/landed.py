"""Queries for sources and sinks. Landed payloads are derived from the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from feedloom.catalog.base import (
    AS_OF, AS_OF_SQL, Registry, dated_items, instant_sql, instant_text, items, table, with_items,
)
from feedloom.catalog.duplicates import REPORT_SQL
from feedloom.catalog.scalars import pages, strip_sql
from feedloom.functions.dates import iso_utc
from feedloom.functions.html import PostSelectors
from feedloom.operators import dedup
from feedloom.operators.filters import recent
from feedloom.operators.joins import enrich_with_source
from feedloom.operators.ranking import number_sorted
from feedloom.schema import conform
from feedloom.session import stage_path
from feedloom.sources import config, feeds, profiles, repos, storage, videos

REGISTRY = Registry()
add = REGISTRY.add

ISO_SQL = "concat(strftime(event_ts, '%Y-%m-%dT%H:%M:%S'), 'Z')"


def iso_event():
    return iso_utc("published_ts")


# --- feeds -------------------------------------------------------------------------------------------


def entries(spark, sf):
    """Parsed feed entries with gaps in every field that has a fallback."""
    ord_, none = F.col("ord"), F.lit(None)
    shaped = items(spark, sf).select(
        "ord",
        F.when(ord_ % 4 != 0, F.col("id")).alias("id"),
        F.when(ord_ % 50 != 3, F.col("title")).alias("title"),
        "link",
        F.when(ord_ % 6 != 5, F.col("summary")).alias("summary"),
        F.lit("described").alias("description"),
        F.when(ord_ % 3 == 0, F.col("author")).alias("author"),
        F.when(ord_ % 3 == 1, F.array(F.struct(F.coalesce("author", F.lit("")).alias("name")))).alias("authors"),
        "published",
        F.when(ord_ % 7 == 2, "2024-01-02T03:04:05").alias("updated"),
        none.cast("string").alias("created"),
        F.when(ord_ % 5 == 0, F.col("published_ts")).alias("published_parsed"),
        F.when(ord_ % 5 == 1, F.col("published_ts")).alias("updated_parsed"),
        none.cast("timestamp").alias("created_parsed"),
        F.coalesce("source", F.lit("src0")).alias("source_key"),
    )
    sources = table(spark, sf, "documents").select(F.col("source").alias("source_key")).distinct().select(
        "source_key", F.concat(F.lit("Feed "), "source_key").alias("source_name"),
        F.when(F.col("source_key") != "src1", "news").alias("source_category"),
    )
    return enrich_with_source(shaped, sources)


ENTRY_DATE = f"""CASE WHEN ord % 5 <= 1 THEN strftime(event_ts, '%Y-%m-%dT%H:%M:%S')
  WHEN published <> '' THEN published WHEN ord % 7 = 2 THEN '2024-01-02T03:04:05'
  ELSE strftime({AS_OF_SQL}, '%Y-%m-%dT%H:%M:%S') END"""


def cut_sql(c: str) -> str:
    c = strip_sql(f"coalesce({c}, '')")
    return f"CASE WHEN length({c}) > 5000 THEN concat(substr({c}, 1, 5000), '...') ELSE {c} END"


@add("s01_normalise_entries", with_items(
    f"""SELECT ord, CASE WHEN ord % 4 <> 0 THEN id ELSE link END AS id,
        {cut_sql("CASE WHEN ord % 50 <> 3 THEN title ELSE 'No title' END")} AS title, link,
        {cut_sql("coalesce(CASE WHEN ord % 6 <> 5 THEN summary END, 'described')")} AS summary,
        {ENTRY_DATE} AS published, concat('Feed ', coalesce(source, 'src0')) AS source,
        CASE WHEN source = 'src1' THEN 'uncategorized' ELSE 'news' END AS category, 'rss' AS content_type,
        CASE WHEN ord % 3 = 0 AND author IS NOT NULL THEN author WHEN ord % 3 = 1 THEN coalesce(author, '')
             ELSE 'Unknown' END AS author
        FROM items WHERE link <> '' AND {cut_sql("CASE WHEN ord % 50 <> 3 THEN title ELSE 'No title' END")} <> ''"""))
def _(spark, sf):
    return feeds.normalise_entries(entries(spark, sf), AS_OF).drop("fetched_at", "published_ts")


@add("s02_entry_date", with_items(f"SELECT ord, {ENTRY_DATE} AS published FROM items"))
def _(spark, sf):
    return entries(spark, sf).select("ord", feeds.entry_date(AS_OF).alias("published"))


@add("s01_read_rss", with_items(
    f"""SELECT id, {strip_sql('title')} AS title, link,
        coalesce(strftime(published_ts, '%Y-%m-%dT%H:%M:%S'), nullif(published, ''), '2024-01-16T00:00:00') AS published,
        'Feed' AS source, coalesce(author, 'Unknown') AS author
        FROM items WHERE link <> '' AND {strip_sql('title')} <> ''"""))
def _(spark, sf):
    folder = stage_path(spark, "rss")
    shaped = items(spark, sf).select(
        F.col("id").alias("guid"), "title", "link", F.when(F.col("ord") % 2 == 0, F.col("author")).alias("author"),
        F.when(F.col("ord") % 2 == 1, F.col("author")).alias("dc_creator"), F.col("published").alias("pubDate"),
    )
    lines = shaped.select(F.to_xml(F.struct("*"), {"rowTag": "item"}).alias("value"))
    lines = lines.select(F.replace("value", F.lit("dc_creator>"), F.lit("dc:creator>")).alias("value"))

    def documents_of(parts):
        yield pd.DataFrame({"value": ['<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>']})
        yield from parts
        yield pd.DataFrame({"value": ["</channel></rss>"]})

    lines.mapInPandas(documents_of, "value string").write.text(folder)
    found = feeds.read_rss(spark, folder).withColumns(
        {"source_name": F.lit("Feed"), "source_category": F.lit(None).cast("string")}
    )
    read = feeds.normalise_entries(found, AS_OF)
    return read.select("id", "title", "link", "published", "source", "author")


@add("s01_read_atom", with_items(
    f"""SELECT id, {strip_sql('title')} AS title, link,
        coalesce(strftime(published_ts, '%Y-%m-%dT%H:%M:%S'), nullif(published, ''), '2024-01-16T00:00:00') AS published,
        'Feed' AS source, coalesce(author, 'Unknown') AS author
        FROM items WHERE link <> '' AND {strip_sql('title')} <> ''"""))
def _(spark, sf):
    """Links are attributes, authors elements, and one half of the entries has only the time of its update."""
    folder = stage_path(spark, "atom")
    even = F.col("ord") % 2 == 0
    shaped = items(spark, sf).select(
        "id", "title", F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel")).alias("link"),
        F.when(F.col("author").isNotNull(), F.struct(F.col("author").alias("name"))).alias("author"),
        F.when(even, F.col("published")).alias("published"), F.when(~even, F.col("published")).alias("updated"),
    )
    shaped.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(folder)
    found = feeds.read_atom(spark, folder).withColumns(
        {"source_name": F.lit("Feed"), "source_category": F.lit(None).cast("string")}
    )
    return feeds.normalise_entries(found, AS_OF).select("id", "title", "link", "published", "source", "author")


# --- repository events -------------------------------------------------------------------------------


def payloads(spark, sf, schema, **fields):
    """API payloads: written as JSON text and read back through the payload schema."""
    base = items(spark, sf)
    payload = F.to_json(F.struct("ord", *[c.alias(n) for n, c in fields.items()]))
    return base.select(F.from_json(payload, schema).alias("p")).select("p.*")


def event_fields():
    ord_ = F.col("ord")
    return {
        "id": ord_.cast("string"), "title": F.col("title"), "body": F.col("summary"), "html_url": F.col("link"),
        "created_at": F.when(ord_ % 23 != 1, iso_event()), "updated_at": iso_event(),
        "repo_name": F.coalesce("source", F.lit("src0")), "category": F.col("category"),
        "user": F.when(F.col("author").isNotNull(), F.struct(F.col("author").alias("login"))),
    }


def release_payloads(spark, sf):
    ord_, shared = F.col("ord"), event_fields()
    return payloads(
        spark, sf, repos.RELEASE, id=shared["id"], body=shared["body"], html_url=shared["html_url"],
        repo_name=shared["repo_name"], category=shared["category"], author=shared["user"],
        name=F.when(ord_ % 6 != 0, F.col("title")), tag_name=F.concat(F.lit("v"), ord_.cast("string")),
        draft=F.when(ord_ % 9 != 1, ord_ % 7 == 0), published_at=F.when(ord_ % 8 != 7, iso_event()),
    )


def pull_payloads(spark, sf):
    ord_ = F.col("ord")
    return payloads(
        spark, sf, repos.PULL_REQUEST, **event_fields(), state=F.when(ord_ % 10 != 0, "closed"),
        merged_at=F.when(ord_ % 4 == 0, iso_event()),
    )


def repo_sql(kind: str, title: str, published: str, author: str, where: str, key: str = "CAST(ord AS VARCHAR)") -> str:
    return (
        f"SELECT ord, concat('github-{kind}-', {key}) AS id, {title} AS title, link, "
        f"coalesce(summary, '') AS summary, {published} AS published, "
        f"concat('GitHub - ', coalesce(source, 'src0')) AS source, coalesce(category, 'github') AS category, "
        f"'github_{kind}' AS content_type, {author} AS author FROM items WHERE {where}"
    )


AUTHOR = "coalesce(author, 'Unknown')"
WEEK = f"ord % 23 <> 1 AND date_trunc('second', event_ts) >= {AS_OF_SQL} - INTERVAL 7 DAY"
RELEASES_SQL = repo_sql(
    "release", "concat('Release ', CASE WHEN ord % 6 <> 0 THEN title ELSE concat('v', CAST(ord AS VARCHAR)) END)",
    ISO_SQL, AUTHOR, "(ord % 9 = 1 OR ord % 7 <> 0) AND ord % 8 <> 7")
PULLS_SQL = repo_sql(
    "pr", "concat('PR: ', title, ' (', CASE WHEN ord % 4 = 0 THEN 'merged' WHEN ord % 10 <> 0 THEN 'closed' ELSE 'open' END, ')')",
    ISO_SQL, AUTHOR, WEEK)
DROP = ("fetched_at", "published_ts")


@add("s03_releases", with_items(RELEASES_SQL))
def _(spark, sf):
    return repos.releases(release_payloads(spark, sf), AS_OF).drop(*DROP)


@add("s04_pull_requests", with_items(PULLS_SQL))
def _(spark, sf):
    return repos.pull_requests(pull_payloads(spark, sf), AS_OF).drop(*DROP)


@add("s05_issues", with_items(repo_sql(
    "issue", "concat('Issue: ', title, ' (open)')", ISO_SQL, AUTHOR, f"ord % 5 <> 2 AND {WEEK}")))
def _(spark, sf):
    is_pull = F.when(F.col("ord") % 5 == 2, F.struct(F.lit("https://example.org/pull").alias("url")))
    issues = payloads(spark, sf, repos.ISSUE, **event_fields(), state=F.lit("open"), pull_request=is_pull)
    return repos.issues(issues, AS_OF).drop(*DROP)


LINE = "split_part(coalesce(summary, ''), chr(10), 1)"


@add("s06_commits", with_items(repo_sql(
    "commit", f"concat('Commit: ', CASE WHEN length({LINE}) > 60 THEN concat(substr({LINE}, 1, 60), '...') ELSE {LINE} END)",
    ISO_SQL, "CASE WHEN ord % 3 = 0 AND author IS NOT NULL THEN author WHEN ord % 5 = 0 THEN 'Unknown' ELSE coalesce(source, 'src0') END",
    f"ord % 11 <> 0 AND date_trunc('second', event_ts) >= {AS_OF_SQL} - INTERVAL 3 DAY",
    "md5(CAST(ord AS VARCHAR))")))
def _(spark, sf):
    ord_, shared = F.col("ord"), event_fields()
    written = F.struct(
        F.when(ord_ % 11 != 0, iso_event()).alias("date"), F.when(ord_ % 5 != 0, F.coalesce("source", F.lit("src0"))).alias("name")
    )
    commits = payloads(
        spark, sf, repos.COMMIT, sha=F.md5(ord_.cast("string").cast("binary")), html_url=shared["html_url"],
        repo_name=shared["repo_name"], category=shared["category"],
        commit=F.struct(F.col("summary").alias("message"), written.alias("author")),
        author=F.when(ord_ % 3 == 0, shared["user"]),
    )
    return repos.commits(commits, AS_OF).drop(*DROP)


@add("s07_repository_activity", with_items(
    f"""SELECT *, row_number() OVER (ORDER BY source, published DESC NULLS LAST, content_type DESC, ord) - 1 AS pos
        FROM ({RELEASES_SQL} UNION ALL {PULLS_SQL})"""))
def _(spark, sf):
    parts = [repos.releases(release_payloads(spark, sf), AS_OF), repos.pull_requests(pull_payloads(spark, sf), AS_OF)]
    return number_sorted(repos.repository_activity(parts)).drop(*DROP)


# --- videos, profiles, configuration -----------------------------------------------------------------


@add("s08_channel_videos", with_items(
    f"""SELECT ord, CAST(ord AS VARCHAR) AS id, title, coalesce(summary, 'No description') AS summary,
        concat('https://www.youtube.com/watch?v=', CAST(ord AS VARCHAR)) AS link,
        CASE WHEN ord % 6 <> 0 THEN {ISO_SQL} END AS published, concat('YouTube - ', s) AS source,
        coalesce(category, 'YouTube') AS category, '' AS thumbnail
        FROM (SELECT *, coalesce(source, 'src0') AS s, row_number() OVER (PARTITION BY coalesce(source, 'src0') ORDER BY ord) AS rn FROM items)
        WHERE rn <= 10 AND ord % 17 <> 4
          AND (ord % 6 = 0 OR date_trunc('second', event_ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY)"""))
def _(spark, sf):
    ord_ = F.col("ord")
    listed = items(spark, sf).select(
        "ord", F.coalesce("source", F.lit("src0")).alias("channel_name"), "category",
        F.struct(
            F.col("title"), F.col("summary").alias("description"),
            F.when(ord_ % 6 != 0, iso_event()).alias("publishedAt"),
            F.struct(F.when(ord_ % 17 != 4, ord_.cast("string")).alias("videoId")).alias("resourceId"),
            F.struct(F.struct(F.lit(None).cast("string").alias("url")).alias("high")).alias("thumbnails"),
        ).alias("snippet"),
    )
    return videos.channel_videos(listed, "2024-01-31").drop("published_ts")


# The pages of the test tables keep paragraphs where profile pages keep posts.
ARTICLES = PostSelectors(containers=("li",), text=("a",), title=("span",), link=("a",), time=("time",))


def navigation_posts(spark, sf):
    source = pages(spark, sf).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), "url",
        F.lit(None).cast("string").alias("category"), "html",
    )
    return profiles.profile_posts(source, AS_OF, ARTICLES, host="https://site.example.org")


LINKS_SQL = """SELECT name, url, i - 1 AS page_pos, regexp_extract(a[i], '>([^<]*)$', 1) AS content,
    regexp_extract(a[i], 'href="([^"]*)"', 1) AS href
  FROM (SELECT name, url, a, unnest(range(1, len(a) + 1)) AS i
        FROM (SELECT concat('page-', CAST(page_id AS VARCHAR)) AS name, url,
                regexp_extract_all(html, '<li><a [^>]*>[^<]*') AS a FROM pages))"""


@add("s09_profile_posts", f"""
SELECT CAST(page_pos AS INT) AS page_pos, concat('https://site.example.org', href) AS id, content AS title,
  concat('https://site.example.org', href) AS link, content AS summary, '2024-01-16T00:00:00Z' AS published,
  concat('LinkedIn - ', name) AS source, 'linkedin' AS category, 'linkedin' AS content_type, name AS author
FROM ({LINKS_SQL})""")
def _(spark, sf):
    return navigation_posts(spark, sf).drop(*DROP)


@add("s10_positional_ids", f"""
SELECT concat('linkedin-', name, '-', CAST(page_pos AS VARCHAR)) AS id, url AS link FROM ({LINKS_SQL})""")
def _(spark, sf):
    no_link = PostSelectors(ARTICLES.containers, ARTICLES.text, ARTICLES.title, ("area",), ARTICLES.time)
    source = pages(spark, sf).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), "url",
        F.lit("x").alias("category"), "html",
    )
    return profiles.profile_posts(source, AS_OF, no_link).select("id", "link")


@add("s11_read_config", """SELECT page_id // 50 AS config, CAST(row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS INT) AS source_ord,
  CAST(page_id AS VARCHAR) AS name, url, 'c' || CAST(page_id % 3 AS VARCHAR) AS category FROM pages""")
def _(spark, sf):
    """A configuration document for every fifty pages, and the feeds of each with their positions."""
    folder, id_ = stage_path(spark, "config"), F.col("page_id")
    feed = F.struct(id_.cast("string").alias("name"), "url", F.concat(F.lit("c"), (id_ % 3).cast("string")).alias("category"))
    feeds = F.transform(F.array_sort(F.collect_list(F.struct("page_id", feed.alias("feed")))), lambda x: x["feed"])
    pages(spark, sf).groupBy(F.floor(id_ / 50).alias("config")).agg(feeds.alias("rss_feeds")).write.partitionBy("config").json(folder)
    found = config.read_config(spark, folder).withColumn("file", F.col("_metadata.file_path"))
    number = F.regexp_extract("file", "config=([0-9]+)", 1).cast("long").alias("config")
    return found.select(number, F.posexplode("rss_feeds").alias("source_ord", "row")).select("config", "source_ord", "row.*")


@add("s11_valid_feeds", """SELECT page_id AS source_ord, title AS name, url, category FROM (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, CASE WHEN page_id % 4 = 1 THEN substr(url, 6) ELSE url END AS url,
    CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('c', 51) ELSE 'news' END AS category FROM pages)
  WHERE title <> '' AND regexp_matches(url, '^https?://') AND category <> '' AND length(title) <= 100 AND length(category) <= 50""")
def _(spark, sf):
    id_ = F.col("page_id")
    configured = pages(spark, sf).select(
        id_.alias("source_ord"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("name"),
        F.when(id_ % 4 == 1, F.expr("substring(url, 6)")).otherwise(F.col("url")).alias("url"),
        F.when(id_ % 5 == 0, "").when(id_ % 5 == 1, "c" * 51).otherwise("news").alias("category"),
    )
    return config.valid_feeds(configured)


# --- storage -----------------------------------------------------------------------------------------

STORED = ("ord", "id", "title", "link", "summary", "published", "source", "category", "author")
STORED_SQL = f"SELECT {', '.join(STORED)}, {instant_sql('published_ts')} AS at FROM items"


def stored(df):
    return df.select(*STORED, instant_text(F.date_trunc("second", "published_ts"), "at"))


@add("s12_load_items", with_items(STORED_SQL))
def _(spark, sf):
    folder = stage_path(spark, "load")
    conform(dated_items(spark, sf)).write.json(folder)
    return stored(storage.load_items(spark, folder))


@add("s12_roundtrip", with_items(STORED_SQL))
def _(spark, sf):
    """What one run saves, the default settings load."""
    return stored(storage.load_items(spark, storage.save_items(conform(dated_items(spark, sf)), stage_path(spark, "round"), "20240116_000000")))


@add("s12_load_without_ord", with_items("SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, id FROM items"))
def _(spark, sf):
    """Items as crawlers leave them, in ordered files without positions."""
    folder = stage_path(spark, "plain")
    conform(dated_items(spark, sf)).orderBy("ord").drop("ord", "published_ts").write.json(folder)
    return storage.load_ordered_items(spark, folder).select("ord", "id")


@add("s13_save_items", with_items(STORED_SQL))
def _(spark, sf):
    root = stage_path(spark, "save")
    storage.save_items(conform(dated_items(spark, sf)), root, "20240116_000000", "parquet")
    return stored(storage.load_snapshots(spark, root, "parquet"))


@add("s14_latest_snapshot", with_items(f"{STORED_SQL} WHERE published_ts >= {AS_OF_SQL} - INTERVAL 2 DAY"))
def _(spark, sf):
    root = stage_path(spark, "snapshots")
    everything = conform(dated_items(spark, sf))
    storage.save_items(everything, root, "20240115_000000")
    storage.save_items(recent(everything, AS_OF, 2), root, "20240116_000000")
    return stored(storage.latest_snapshot(spark, root))


@add("s15_stage_handoff", with_items(STORED_SQL))
def _(spark, sf):
    uri = storage.store_stage(dated_items(spark, sf), stage_path(spark, "handoff"), "filtered", "20240116_000000")
    return stored(storage.retrieve_stage(spark, uri))


@add("s16_dedup_job", REPORT_SQL)
def _(spark, sf):
    source, target = stage_path(spark, "dedup-in"), stage_path(spark, "dedup-out")
    conform(dated_items(spark, sf)).write.json(source)
    return dedup.dedup_job(spark, source, target, AS_OF)


@add("s16_dedup_job_plain", REPORT_SQL)
def _(spark, sf):
    """The job over items that carry neither a position nor a parsed time."""
    source, target = stage_path(spark, "plain-in"), stage_path(spark, "plain-out")
    conform(dated_items(spark, sf)).orderBy("ord").drop("ord", "published_ts").coalesce(1).write.json(source)
    return dedup.dedup_job(spark, source, target, AS_OF)
