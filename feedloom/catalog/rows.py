"""Queries for filters, aggregates, ranking, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.base import (
    AS_OF, AS_OF_SQL, Registry, dated_items, documents, instant_sql, instant_text, items, table, with_items,
)
from feedloom.catalog.scalars import mentions_sql, score_sql, strip_sql
from feedloom.functions import scoring
from feedloom.operators import filters, joins, ranking, stats, unions
from feedloom.session import stage_path
from feedloom.sources import cache

REGISTRY = Registry()
add = REGISTRY.add

LOWER = "lower(title), lower(coalesce(summary, ''))"
SCORED = f"scored AS (SELECT *, {score_sql(scoring.WORKFLOW_PRESET)} AS relevance_score FROM items)"
NEWEST = "published_ts DESC NULLS LAST, ord"


def scored(spark, sf):
    return scoring.with_relevance(items(spark, sf))


# --- filters -----------------------------------------------------------------------------------------


@add("p01_by_category", with_items("SELECT ord, category FROM items WHERE category = 'view'"))
def _(spark, sf):
    return filters.by_category(items(spark, sf), "view").select("ord", "category")


def recent_sql(days: int) -> str:
    return with_items(
        f"SELECT ord, {instant_sql('published_ts')} AS at FROM items "
        f"WHERE published_ts >= {AS_OF_SQL} - INTERVAL {days} DAY"
    )


@add("p02_recent", recent_sql(7))
def _(spark, sf):
    return filters.recent(dated_items(spark, sf), AS_OF, 7).select("ord", instant_text("published_ts", "at"))


@add("p03_recent_capped", recent_sql(2))
def _(spark, sf):
    return filters.recent_capped(dated_items(spark, sf), AS_OF, 7).select("ord", instant_text("published_ts", "at"))


@add("p04_search", with_items(
    "SELECT ord, title FROM items WHERE contains(lower(title), 'copilot') OR contains(lower(coalesce(summary, '')), 'copilot')"))
def _(spark, sf):
    return filters.search(documents(spark, sf), "Copilot").select("ord", "title")


@add("p05_valid_items", with_items("SELECT ord, link FROM items WHERE title <> '' AND regexp_matches(link, '^https?://')"))
def _(spark, sf):
    return filters.valid_items(documents(spark, sf)).select("ord", "link")


@add("p06_on_topic", with_items(
    f"SELECT ord, ({mentions_sql(scoring.TOPIC_PHRASES, 'lower(title)')} OR "
    f"{mentions_sql(scoring.TOPIC_PHRASES, "lower(coalesce(summary, ''))")}) AS on_topic FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", scoring.is_on_topic("title", "summary").alias("on_topic"))


@add("p07_mentions_competitor", with_items(
    f"SELECT ord, {mentions_sql(scoring.COMPETITORS.phrases, f'concat_ws({chr(39)} {chr(39)}, {LOWER})')} AS competitor FROM items"))
def _(spark, sf):
    return documents(spark, sf).select("ord", scoring.mentions_competitor("title", "summary").alias("competitor"))


@add("p08_relevance_split", with_items(
    "SELECT ord, relevance_score, CASE WHEN relevance_score >= 30 THEN 'relevant' ELSE 'general' END AS part FROM scored",
    SCORED))
def _(spark, sf):
    both = scoring.with_relevance(documents(spark, sf))
    part = lambda df, name: df.select("ord", "relevance_score", F.lit(name).alias("part"))
    return part(filters.relevant(both), "relevant").unionByName(part(filters.not_relevant(both), "general"))


def unsummarised(spark, sf):
    """Items with every other summary removed, a score on some, batches of ten."""
    blank = documents(spark, sf).withColumns(
        {
            "summary": F.when(F.col("ord") % 2 != 0, F.col("summary")),
            "ai_summary": F.lit(None).cast("string"),
            "generated_summary": F.when(F.col("ord") % 7 == 0, F.lit("done")),
            "relevance_score": F.when(F.col("ord") % 5 == 0, 0).when(F.col("ord") % 5 == 1, 40),
        }
    )
    return ranking.assign_batches(blank, 10, dense=True)


UNSUMMARISED = """unsummarised AS (SELECT ord, CASE WHEN ord % 2 <> 0 THEN summary END AS summary, link, description,
  CASE WHEN ord % 7 = 0 THEN 'done' END AS generated_summary,
  CASE WHEN ord % 5 = 0 THEN 0 WHEN ord % 5 = 1 THEN 40 END AS relevance_score, ord // 10 AS batch_index FROM items)"""
NEEDS = """(coalesce(summary, '') = '' AND length(coalesce(description, '')) >= 50
  AND coalesce(relevance_score, 1.0) >= 0.1)"""


@add("p09_needs_summary", with_items(f"SELECT ord, {NEEDS} AS needs FROM unsummarised", UNSUMMARISED))
def _(spark, sf):
    return unsummarised(spark, sf).select("ord", filters.needs_summary().alias("needs"))


@add("p10_needs_summary_strict", with_items(
    """SELECT ord, (length(coalesce(description, '')) >= 200 AND coalesce(summary, '') = ''
       AND coalesce(relevance_score, 0) >= 0.3) AS needs FROM unsummarised""", UNSUMMARISED))
def _(spark, sf):
    return unsummarised(spark, sf).select("ord", filters.needs_summary_strict().alias("needs"))


@add("p11_batch_gate", with_items(
    f"SELECT ord, batch_index, bool_or({NEEDS}) OVER (PARTITION BY batch_index) AS eligible FROM unsummarised",
    UNSUMMARISED))
def _(spark, sf):
    gated = filters.batch_gate(unsummarised(spark, sf), filters.needs_summary())
    return gated.select("ord", "batch_index", "eligible")


@add("p12_summary_route", with_items(
    f"""SELECT ord, CASE WHEN coalesce(generated_summary, '') = '' THEN
         CASE WHEN length({strip_sql("coalesce(summary, '')")}) >= 100 THEN 'content' WHEN link <> '' THEN 'url' END
       END AS route FROM unsummarised""", UNSUMMARISED))
def _(spark, sf):
    return unsummarised(spark, sf).select("ord", filters.summary_route().alias("route"))


@add("p14_preview", with_items(
    """SELECT ord, title, source, link, (SELECT greatest(count(*) - 10, 0) FROM items) AS more
       FROM items ORDER BY ord LIMIT 10"""))
def _(spark, sf):
    df = documents(spark, sf)
    return ranking.preview(df).withColumn("more", ranking.remaining(df).scalar())


# --- ranking -----------------------------------------------------------------------------------------


def organised_sql(where: str) -> str:
    return with_items(
        f"""SELECT * FROM (SELECT ord, coalesce(category, 'uncategorized') AS category,
          row_number() OVER (PARTITION BY coalesce(category, 'uncategorized') ORDER BY {NEWEST}) AS rn FROM items)
        {where}"""
    )


@add("w01_organise_by_category", with_items(
    f"""SELECT ord, category, row_number() OVER (ORDER BY first_ord, {NEWEST}) - 1 AS pos FROM (
        SELECT ord, published_ts, coalesce(category, 'uncategorized') AS category,
          min(ord) OVER (PARTITION BY coalesce(category, 'uncategorized')) AS first_ord FROM items)"""))
def _(spark, sf):
    items = dated_items(spark, sf).select("ord", "category", "published_ts")
    return ranking.number_sorted(ranking.organise_by_category(items)).select("ord", "category", "pos")


@add("w02_top_per_category", organised_sql("WHERE rn <= 10"))
def _(spark, sf):
    return ranking.top_per_category(dated_items(spark, sf), 10).select("ord", "category", F.col("rn").cast("long"))


@add("w02_recent_top_per_category", with_items(
    f"""SELECT * FROM (SELECT ord, coalesce(category, 'uncategorized') AS category, title,
          {instant_sql('published_ts')} AS at,
          row_number() OVER (PARTITION BY coalesce(category, 'uncategorized') ORDER BY {NEWEST}) AS rn
        FROM items WHERE published_ts >= {AS_OF_SQL} - INTERVAL 7 DAY) WHERE rn <= 10"""))
def flagship(spark, sf):
    """Newest ten of every category in the last seven days."""
    top = ranking.top_per_category(filters.recent(dated_items(spark, sf), AS_OF, 7), 10)
    return top.select("ord", "category", "title", instant_text("published_ts", "at"), F.col("rn").cast("long"))


@add("w02_top_per_category_lexical", with_items(
    """SELECT * FROM (SELECT ord, coalesce(category, 'uncategorized') AS category,
          row_number() OVER (PARTITION BY coalesce(category, 'uncategorized') ORDER BY published DESC, ord) AS rn
        FROM items) WHERE rn <= 10"""))
def _(spark, sf):
    top = ranking.top_per_category(items(spark, sf), 10, lexical=True)
    return top.select("ord", "category", F.col("rn").cast("long"))


@add("w03_top_half_per_category", organised_sql("WHERE rn <= 5"))
def _(spark, sf):
    return ranking.top_half_per_category(dated_items(spark, sf), 10).select(
        "ord", "category", F.col("rn").cast("long")
    )


@add("w04_top_per_source", with_items(
    """SELECT * FROM (SELECT ord, source, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM items)
       WHERE rn <= 3"""))
def _(spark, sf):
    return ranking.top_per_source(documents(spark, sf)).select("ord", "source", F.col("rn").cast("long"))


@add("w05_category_order", with_items(
    "SELECT coalesce(category, 'uncategorized') AS category, min(ord) AS first_ord FROM items GROUP BY 1"))
def _(spark, sf):
    return ranking.category_order(items(spark, sf))


@add("w06_assign_batches", with_items(
    f"""SELECT ord, rn - 1 AS pos, (rn - 1) // 10 AS batch_index FROM (
        SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM items)"""))
def _(spark, sf):
    return ranking.assign_batches(items(spark, sf).select("ord"), 10).select("ord", "pos", "batch_index")


@add("w06_assign_sub_batches", with_items(
    "SELECT ord, ord // 10 AS batch_index, (ord // 10) * 4 + (ord % 10) // 3 AS sub_batch FROM items"))
def _(spark, sf):
    batched = ranking.assign_batches(documents(spark, sf), 10, dense=True)
    return ranking.assign_sub_batches(batched, 10, 3).select("ord", "batch_index", "sub_batch")


@add("o01_sort_newest", with_items(
    f"SELECT ord, {instant_sql('published_ts')} AS at, row_number() OVER (ORDER BY {NEWEST}) - 1 AS pos FROM items"))
def _(spark, sf):
    df = dated_items(spark, sf).withColumn("_age", -F.coalesce(F.unix_micros("published_ts"), F.lit(-(1 << 62))))
    placed = ranking.dense_positions(df.select("ord", "published_ts", "_age"), ["_age", "ord"])
    return placed.select("ord", instant_text("published_ts", "at"), "pos")


@add("o02_sort_relevant", with_items(
    "SELECT ord, relevance_score, row_number() OVER (ORDER BY relevance_score DESC, ord) - 1 AS pos FROM scored", SCORED))
def _(spark, sf):
    ordered = ranking.sort_relevant(scoring.with_relevance(documents(spark, sf)).select("ord", "relevance_score"))
    return ranking.number_sorted(ordered)


@add("o03_top_relevant", with_items(
    "SELECT ord, relevance_score FROM scored ORDER BY relevance_score DESC, ord LIMIT 10", SCORED))
def _(spark, sf):
    return ranking.top_relevant(scoring.with_relevance(documents(spark, sf)), 10).select("ord", "relevance_score")


# --- aggregates --------------------------------------------------------------------------------------


@add("a01_count_by_source", with_items(
    "SELECT coalesce(source, 'Unknown') AS source, count(*) AS items, min(ord) AS first_ord FROM items GROUP BY 1"))
def _(spark, sf):
    return stats.count_by_source(documents(spark, sf))


@add("a02_count_by_category", with_items(
    "SELECT coalesce(category, 'uncategorized') AS category, count(*) AS items, min(ord) AS first_ord FROM items GROUP BY 1"))
def _(spark, sf):
    return stats.count_by_category(items(spark, sf))


ORIGIN = "CASE content_type WHEN 'rss' THEN 'rss' WHEN 'linkedin' THEN 'youtube' ELSE 'github' END"


@add("a03_fetch_stats", with_items(
    f"""SELECT count(*) FILTER (o = 'rss') AS rss_count, count(*) FILTER (o = 'github') AS github_count,
        count(*) FILTER (o = 'youtube') AS youtube_count, count(*) AS total_items
        FROM (SELECT {ORIGIN} AS o FROM items)"""))
def _(spark, sf):
    return stats.fetch_stats(documents(spark, sf).withColumn("origin", F.expr(ORIGIN)))


@add("a04_filter_stats", with_items(
    f"""SELECT count(*) AS original_count,
        count(*) FILTER (published_ts >= {AS_OF_SQL} - INTERVAL 2 DAY) AS filtered_count FROM items"""))
def _(spark, sf):
    kept = F.col("published_ts") >= filters.days_before(AS_OF, 2)
    return stats.filter_stats(dated_items(spark, sf), kept)


@add("a05_batch_descriptors", """SELECT batch_index, min(pos) AS batch_start, max(pos) + 1 AS batch_end,
  count(*) AS item_count, CAST(25 AS BIGINT) AS batch_size
  FROM (SELECT rn - 1 AS pos, (rn - 1) // 25 AS batch_index
        FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn FROM events))
  GROUP BY batch_index""")
def _(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("ord"))
    return stats.batch_descriptors(ranking.assign_batches(events, 25), 25)


@add("a05_batch_totals", "SELECT (count(*) + 24) // 25 AS num_batches, count(*) AS total_items FROM events")
def _(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("ord"))
    return stats.batch_totals(ranking.assign_batches(events, 25, dense=True))


@add("a06_summary_stats", with_items(
    """SELECT CAST(sum(items) AS BIGINT) AS total_items, CAST(sum(n) AS BIGINT) AS summarized_count FROM (
       SELECT batch_index, count(*) AS items, count(*) FILTER (generated_summary <> '') AS n
       FROM unsummarised GROUP BY batch_index)""", UNSUMMARISED))
def _(spark, sf):
    return stats.summary_stats(unsummarised(spark, sf))


@add("a06_summaries_per_batch", with_items(
    """SELECT batch_index, count(*) FILTER (generated_summary <> '') AS summary_count, count(*) AS items
       FROM unsummarised GROUP BY batch_index""", UNSUMMARISED))
def _(spark, sf):
    return stats.summaries_per_batch(unsummarised(spark, sf))


@add("a08_channel_preview", with_items(
    """SELECT source, count(*) AS items, array_to_string(list_slice(list(title ORDER BY ord), 1, 3), ' | ') AS titles,
       greatest(count(*) - 3, 0) AS more FROM items GROUP BY source"""))
def _(spark, sf):
    shown = stats.channel_preview(documents(spark, sf))
    return shown.withColumn("titles", F.array_join("titles", " | ")).select("source", "items", "titles", "more")


# --- joins -------------------------------------------------------------------------------------------


def source_dimension(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("source_key")).distinct().select(
        "source_key",
        F.concat(F.lit("Feed "), "source_key").alias("source_name"),
        F.concat(F.lit("topic-"), F.substring("source_key", -1, 1)).alias("source_category"),
    )


@add("j01_enrich_with_source", with_items(
    """SELECT ord, source AS source_key, concat('Feed ', source) AS source_name,
       concat('topic-', right(source, 1)) AS source_category FROM items WHERE source IS NOT NULL"""))
def _(spark, sf):
    entries = documents(spark, sf).select("ord", F.col("source").alias("source_key"))
    return joins.enrich_with_source(entries, source_dimension(spark, sf))


@add("j02_video_statistics", """SELECT d.doc_id AS video_id, CAST(l.quality * 100 AS VARCHAR) AS views,
  CASE WHEN l.doc_id IS NOT NULL THEN coalesce(CAST(l.toxic AS VARCHAR), '0') END AS likes,
  CASE WHEN l.doc_id IS NOT NULL THEN '0' END AS comments
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("video_id"),
        (F.col("quality") * 100).cast("string").alias("views"),
        F.col("toxic").cast("string").alias("likes"),
        F.lit(None).cast("string").alias("comments"),
    )
    videos = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"))
    return joins.with_video_statistics(videos, labels)


@add("j03_merge_summaries", with_items(
    """SELECT ord, CASE WHEN ord % 3 = 0 AND ord % 2 = 0 THEN concat('s', CAST(ord AS VARCHAR)) ELSE 'old' END AS ai_summary,
       CASE WHEN ord % 3 = 0 THEN concat('s', CAST(ord AS VARCHAR)) END AS generated_summary FROM items"""))
def _(spark, sf):
    base = documents(spark, sf).select(
        "ord", F.lit("old").alias("ai_summary"), F.lit(None).cast("string").alias("generated_summary")
    )
    made = F.concat(F.lit("s"), F.col("ord").cast("string"))
    new = documents(spark, sf).filter(F.col("ord") % 3 == 0).select(
        "ord", F.when(F.col("ord") % 2 == 0, made).otherwise("").alias("ai_summary"), made.alias("generated_summary")
    )
    return joins.merge_summaries(base, new)


def summary_cache(spark, sf):
    """Cache holding the labelled documents."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled.groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(
        F.min(F.substring("text", 1, 150)).alias("cached"), F.lit(1).cast("long").alias("version")
    )


CACHE_SQL = """cache AS (SELECT md5(text) AS hash, min(substr(text, 1, 150)) AS cached FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"""


@add("j04_cache_hits", f"""WITH {CACHE_SQL}
SELECT d.doc_id, md5(d.text) AS hash, c.cached FROM documents d LEFT JOIN cache c ON c.hash = md5(d.text)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return joins.cache_hits(docs, summary_cache(spark, sf), "text").select("doc_id", "hash", "cached")


@add("j04_cache_misses", f"""WITH {CACHE_SQL}
SELECT d.doc_id, md5(d.text) AS hash FROM documents d WHERE md5(d.text) NOT IN (SELECT hash FROM cache)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return joins.cache_misses(docs, summary_cache(spark, sf), "text").select("doc_id", "hash")


@add("j04_cache_hits_url", """SELECT p.page_id, md5(p.url) AS hash, c.cached FROM pages p LEFT JOIN (
  SELECT md5(url) AS hash, concat('page ', CAST(page_id AS VARCHAR)) AS cached FROM pages WHERE page_id % 3 = 0) c ON c.hash = md5(p.url)""")
def _(spark, sf):
    """Rows without content of their own are looked up by their link."""
    landed = table(spark, sf, "pages").select("page_id", "url", F.lit("").alias("content"))
    cached = F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("cached")
    cache = landed.filter("page_id % 3 = 0").select(F.md5(F.col("url").cast("binary")).alias("hash"), cached)
    return joins.cache_hits(landed, cache, "content", "url").select("page_id", "hash", "cached")


@add("j05_cache_upsert", f"""WITH {CACHE_SQL},
fresh AS (SELECT md5(text) AS hash, min(concat('new ', substr(text, 1, 100))) AS summary FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT coalesce(f.hash, c.hash) AS hash, coalesce(f.summary, c.cached) AS summary,
  CAST(CASE WHEN f.hash IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version
FROM cache c FULL JOIN fresh f ON f.hash = c.hash""")
def _(spark, sf):
    fresh = table(spark, sf, "documents").filter("lang = 'en'").groupBy(
        F.md5(F.col("text").cast("binary")).alias("hash")
    ).agg(
        F.min(F.concat(F.lit("new "), F.substring("text", 1, 100))).alias("summary"),
        F.lit(2).cast("long").alias("version"),
    )
    return joins.cache_upsert(summary_cache(spark, sf).withColumnRenamed("cached", "summary"), fresh)


@add("j05_cache_table", f"""WITH {CACHE_SQL},
fresh AS (SELECT md5(text) AS hash, min(concat('new ', substr(text, 1, 100))) AS summary FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT coalesce(f.hash, c.hash) AS hash, coalesce(f.summary, c.cached) AS summary,
  CAST(CASE WHEN f.hash IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version, false AS written_again
FROM cache c FULL JOIN fresh f ON f.hash = c.hash""")
def _(spark, sf):
    """The cache on disk after three writes: labelled documents, English ones with a higher version, and these once more."""
    root = stage_path(spark, "cache")
    labelled = summary_cache(spark, sf).withColumnRenamed("cached", "summary")
    english = table(spark, sf, "documents").filter("lang = 'en'").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(
        F.min(F.concat(F.lit("new "), F.substring("text", 1, 100))).alias("summary"), F.lit(2).alias("version")
    )
    cache.write_cache(root, labelled)
    cache.write_cache(root, english)
    again = cache.write_cache(root, english)
    return cache.read_cache(spark, root).withColumn("written_again", F.lit(again > 0))


@add("j07_count_per_source", with_items(
    """SELECT s.source, count(i.ord) AS items FROM (SELECT DISTINCT source FROM documents
         UNION ALL SELECT DISTINCT concat('mirror of ', source) FROM documents) s
       LEFT JOIN items i ON i.source = s.source AND i.published_ts >= TIMESTAMP '2024-01-14 00:00:00' GROUP BY s.source"""))
def _(spark, sf):
    names = table(spark, sf, "documents").select("source").distinct()
    configured = names.unionByName(names.select(F.concat(F.lit("mirror of "), "source").alias("source")))
    return joins.count_per_source(configured, filters.recent(dated_items(spark, sf), AS_OF, 2))


# --- unions ------------------------------------------------------------------------------------------


def origin_frames(spark, sf):
    """Three origins with different fields: feeds from documents, chats as repositories, pages as profiles."""
    return {
        "rss": documents(spark, sf).select("ord", "title", "link", "summary", "source"),
        "github": table(spark, sf, "conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("role").alias("title"),
            F.col("text").alias("summary"), F.lit("chat").alias("source"), F.lit("user").alias("author"),
        ),
        "youtube": table(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("link")),
    }


ORIGINS_SQL = (
    "SELECT ord, title, link, source, NULL AS author, 'rss' AS origin, 0 AS source_rank FROM items "
    "UNION ALL SELECT conv_id * 1000 + turn, role, NULL, 'chat', 'user', 'github', 1 FROM conversations"
)


@add("u01_union_sources", with_items(
    f"SELECT * FROM ({ORIGINS_SQL} UNION ALL SELECT page_id, NULL, url, NULL, NULL, 'youtube', 2 FROM pages)"))
def _(spark, sf):
    return unions.union_sources(origin_frames(spark, sf)).select(
        "ord", "title", "link", "source", "author", "origin", "source_rank"
    )


@add("u02_union_selected", with_items(f"SELECT * FROM ({ORIGINS_SQL})"))
def _(spark, sf):
    return unions.union_sources(origin_frames(spark, sf), ("rss", "github")).select(
        "ord", "title", "link", "source", "author", "origin", "source_rank"
    )
