"""Queries for digests, summarising, whole runs and streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.catalog.base import (
    AS_OF, AS_OF_SQL, Registry, dated_items, instant_sql, instant_text, with_items,
)
from feedloom.catalog.duplicates import FINGERPRINT, keyed_sql, survivors_sql, walk_sql, with_copies
from feedloom.catalog.rows import NEEDS, NEWEST, UNSUMMARISED, unsummarised
from feedloom.catalog.scalars import (
    clean_sql, digest_date_sql, escape_sql, mentions_sql, norm_url_sql, page_text_sql, pages, score_sql, strip_sql, template_sql,
    title_case_sql, truncate_html_sql,
)
from feedloom.functions import scoring
from feedloom.functions.text import html_to_text
from feedloom.operators import digest, summaries
from feedloom.operators.filters import recent
from feedloom.operators.joins import merge_summaries
from feedloom.operators.ranking import assign_batches, number_sorted
from feedloom.plans import curation
from feedloom.schema import conform, with_published_ts
from feedloom.session import child_names, stage, stage_path
from feedloom.sources import storage
from feedloom.streaming import ingest

REGISTRY = Registry()
add = REGISTRY.add

# --- digests -----------------------------------------------------------------------------------------

CATEGORY = "coalesce(category, 'uncategorized')"
DATE_LINE = f"strftime({AS_OF_SQL}, '%A, %B %d, %Y')"


def html_rows_sql(source: str) -> str:
    """Newest ten of every category with the category's first position."""
    return f"""shown AS (SELECT * FROM (SELECT *, {CATEGORY} AS cat,
      row_number() OVER (PARTITION BY {CATEGORY} ORDER BY {NEWEST}) AS rn,
      min(ord) OVER (PARTITION BY {CATEGORY}) AS first_ord FROM {source}) WHERE rn <= 10)"""


def _slot(c: str) -> str:
    return escape_sql(template_sql(f"coalesce({c}, '')"))


SHORT = truncate_html_sql(clean_sql(template_sql("coalesce(summary, '')")))
HTML_ITEM = f"""concat('<div class="content-item"><div class="source-label">', {_slot('source')}, '</div>',
  '<div class="item-title"><a href="', {_slot('link')}, '" target="_blank">', {_slot('title')}, '</a></div>',
  '<div class="item-meta">Published: ', {digest_date_sql('published')},
  CASE WHEN author <> 'Unknown' THEN concat(' | By: ', author) ELSE '' END, '</div>',
  CASE WHEN {SHORT} <> '' THEN concat('<div class="item-summary">', {SHORT}, '</div>') ELSE '' END, '</div>', chr(10))"""
HTML_SECTIONS = f"""sections AS (SELECT first_ord, concat('<div class="category-section"><div class="category-header">',
  {escape_sql(title_case_sql('cat'))}, '</div>', chr(10), string_agg({HTML_ITEM}, '' ORDER BY rn), '</div>', chr(10)) AS text
  FROM shown GROUP BY cat, first_ord)"""
HTML_PAGE = f"""SELECT concat('<html><body>', chr(10), '<div class="header"><h1>Your Daily Content Digest</h1><div class="date">',
  {DATE_LINE}, '</div></div>', chr(10), string_agg(text, '' ORDER BY first_ord),
  '<div class="footer"><p>This digest was generated by feedloom.</p><p><a href="#">Unsubscribe</a> | <a href="#">Update Preferences</a></p></div>',
  chr(10), '</body></html>') AS digest FROM sections"""


@add("a07_digest_assembly", with_items(
    f"""SELECT cat AS category, string_agg(title, chr(10) ORDER BY rn) AS titles FROM shown GROUP BY cat""",
    html_rows_sql("items")))
def _(spark, sf):
    rows = digest.digest_rows(dated_items(spark, sf), 10)
    return digest.ordered_concat(rows, ["category"], ["rn"], "title", "\n").select(
        "category", F.col("title").alias("titles")
    )


@add("c01_html_digest", with_items(HTML_PAGE, html_rows_sql("items"), HTML_SECTIONS))
def _(spark, sf):
    return digest.html_digest(dated_items(spark, sf), AS_OF, 10)


LOWERED = "concat_ws(' ', lower(title), lower(coalesce(summary, '')))"
TEXT_CTES = (
    f"""scored AS (SELECT *, {score_sql(scoring.DIGEST_PRESET)} AS score, {CATEGORY} AS cat,
      {mentions_sql(scoring.COMPETITORS.phrases, LOWERED)} AS competitor FROM items)""",
    "high AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS rn FROM scored WHERE score >= 30)",
    "rivals AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS rn FROM scored WHERE competitor)",
    f"""rest AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY {NEWEST}) AS rn,
      min(ord) OVER (PARTITION BY cat) AS first_ord FROM scored WHERE score < 30)""",
)


def text_item_sql(score: str, details: bool) -> str:
    middle = (
        f"'  Published: ', {digest_date_sql('published')}, chr(10), "
        "CASE WHEN author <> 'Unknown' THEN concat('  By: ', author, chr(10)) ELSE '' END, " if details else ""
    )
    return (
        f"concat('* ', title, {score}, chr(10), '  Source: ', coalesce(source, ''), chr(10), {middle}"
        "'  Link: ', link, chr(10), chr(10))"
    )


HIGH_ITEM = text_item_sql("' [Relevance: ', CAST(score AS VARCHAR), ']'", True)
TEXT_DIGEST = f"""SELECT concat('YOUR DAILY CONTENT DIGEST', chr(10), {DATE_LINE}, chr(10), repeat('=', 60), chr(10), chr(10),
  (SELECT CASE WHEN count(*) > 0 THEN concat('AMAZON Q & CODING ASSISTANT HIGHLIGHTS', chr(10), repeat('-', 40), chr(10),
     string_agg({HIGH_ITEM}, '' ORDER BY rn), chr(10)) ELSE '' END FROM high WHERE rn <= 10),
  (SELECT CASE WHEN count(*) > 0 THEN concat('COMPETITIVE AWARENESS', chr(10), repeat('-', 40), chr(10),
     string_agg({text_item_sql("''", True)}, '' ORDER BY rn), chr(10)) ELSE '' END FROM rivals WHERE rn <= 10),
  (SELECT CASE WHEN count(*) > 0 THEN concat('GENERAL INDUSTRY NEWS', chr(10), repeat('-', 40), chr(10),
     string_agg(block, '' ORDER BY first_ord)) ELSE '' END FROM (SELECT first_ord, concat(upper(cat), chr(10),
       string_agg({text_item_sql("''", False)}, '' ORDER BY rn), chr(10)) AS block FROM rest WHERE rn <= 5 GROUP BY cat, first_ord)),
  repeat('=', 60), chr(10), 'This digest was generated by feedloom.')"""


@add("c02_text_digest", with_items(f"{TEXT_DIGEST} AS digest", *TEXT_CTES))
def _(spark, sf):
    return digest.text_digest(dated_items(spark, sf), AS_OF, 10)


@add("s17_save_digest", with_items(
    f"SELECT unnest(string_split(d, chr(10))) AS value FROM ({TEXT_DIGEST} AS d)", *TEXT_CTES))
def _(spark, sf):
    path = stage_path(spark, "digest")
    storage.save_digest(digest.text_digest(dated_items(spark, sf), AS_OF), path)
    return spark.read.text(path)


# --- summarising -------------------------------------------------------------------------------------



def summarised_sql(made: str) -> str:
    return f"""SELECT ord, CASE WHEN eligible AND coalesce(generated_summary, '') = ''
      AND length({strip_sql("coalesce(summary, '')")}) >= 100 THEN {made} ELSE generated_summary END
      AS generated_summary FROM gated"""


GATED = f"""gated AS (SELECT *, bool_or({NEEDS}) OVER (PARTITION BY batch_index) AS eligible FROM unsummarised)"""


@add("c03_batch_summarise", with_items(summarised_sql("concat(substr(summary, 1, 150), '...')"), UNSUMMARISED, GATED))
def _(spark, sf):
    return summaries.batch_summarise(unsummarised(spark, sf)).select("ord", "generated_summary")


def first_words(texts: list[str]) -> list[str]:
    """Stand-in for a model: the first five blank-separated words."""
    return [" ".join(t.split(" ")[:5]) for t in texts]


# Only texts wrapped in markup are cleaned before the call, and the first words hold the lines' breaks.
FIRST_WORDS = """array_to_string(list_slice(string_split(CASE WHEN starts_with(summary, '<')
  THEN replace(substr(summary, 4), chr(10), ' ') ELSE summary END, ' '), 1, 5), ' ')"""


@add("c03_batch_summarise_callable", with_items(summarised_sql(FIRST_WORDS), UNSUMMARISED, GATED))
def _(spark, sf):
    done = summaries.batch_summarise(unsummarised(spark, sf), first_words)
    return done.select("ord", "generated_summary")


def no_call(texts: list[str]) -> list[str]:
    """Stand-in for a model that must not be called."""
    raise RuntimeError(f"called for {len(texts)} texts")


@add("c03_cache_roundtrip", with_items(summarised_sql(FIRST_WORDS), UNSUMMARISED, GATED))
def _(spark, sf):
    """Summaries go to the cache of a first run; a second run takes all of them from there."""
    items = unsummarised(spark, sf)
    made = summaries.batch_summarise(items, first_words)
    cache = stage(summaries.fresh_cache_rows(made, 1), "summary-cache")
    return summaries.batch_summarise(items, no_call, cache=cache).select("ord", "generated_summary")


@add("c03_call_log", with_items(summarised_sql(FIRST_WORDS), UNSUMMARISED, GATED))
def _(spark, sf):
    """Half of the items are summarised by a run that logs its calls; the run over all calls for the others only."""
    items, log = unsummarised(spark, sf), stage_path(spark, "calls")
    summaries.batch_summarise(items.filter("batch_index % 2 = 0"), first_words, log=log, waves=2)
    return summaries.batch_summarise(items, first_words, log=log, waves=2).select("ord", "generated_summary")


@add("c03_summarise_pages", f"""
WITH texts AS (SELECT page_id, url, {page_text_sql('html')} AS body FROM pages),
landed AS (SELECT url, min(body) AS body FROM texts GROUP BY url)
SELECT t.page_id AS ord, CASE WHEN length(l.body) < 100 THEN l.body
  ELSE array_to_string(list_slice(string_split(l.body, ' '), 1, 5), ' ') END AS generated_summary
FROM texts t JOIN landed l ON l.url = t.url""")
def _(spark, sf):
    """Items without content take the text of their page, by link."""
    landed = pages(spark, sf)
    items = landed.select(
        F.col("page_id").alias("ord"), F.col("url").alias("link"), F.lit("").alias("summary"),
        F.lit("d" * 60).alias("description"), F.lit(None).cast("string").alias("ai_summary"),
        F.lit(None).cast("string").alias("generated_summary"), F.lit(None).cast("int").alias("relevance_score"),
        F.floor(F.col("page_id") / 10).alias("batch_index"),
    )
    texts = landed.select(F.col("url").alias("link"), html_to_text("html").alias("text"))
    return summaries.batch_summarise(items, first_words, pages=texts).select("ord", "generated_summary")


WEEK = f"published_ts >= {AS_OF_SQL} - INTERVAL 7 DAY"
CHAINED = f"""chained AS (SELECT * REPLACE (coalesce(nullif(made, ''), summary) AS summary) FROM (SELECT *,
  CASE WHEN bool_or(coalesce(summary, '') = '' AND length(coalesce(description, '')) >= 50) OVER (PARTITION BY batch_index)
    AND length({strip_sql("coalesce(summary, '')")}) >= 100 THEN concat(substr(summary, 1, 150), '...') END AS made
  FROM (SELECT *, (row_number() OVER (ORDER BY ord) - 1) // 10 AS batch_index FROM items WHERE {WEEK})))"""


@add("c03_stage_chain", with_items(HTML_PAGE, CHAINED, html_rows_sql("chained"), HTML_SECTIONS))
def _(spark, sf):
    """Recent items, batches of ten, summaries, merge by item, and the digest that shows the summaries."""
    fields = {n: F.lit(None).cast(t) for n, t in (("relevance_score", "int"), ("generated_summary", "string"), ("ai_summary", "string"))}
    found = recent(dated_items(spark, sf), AS_OF, 7).withColumns(fields)
    batched = assign_batches(found)
    made = summaries.publish_summaries(summaries.batch_summarise(batched))
    merged = merge_summaries(batched, made)
    shown = merged.withColumn("summary", F.coalesce(F.nullif(F.col("ai_summary"), F.lit("")), F.col("summary")))
    return digest.html_digest(shown, AS_OF, 10)


# --- whole runs --------------------------------------------------------------------------------------


def frames(spark, sf):
    """The items split by origin."""
    everything = dated_items(spark, sf)
    kind = F.col("content_type")
    return {
        "rss": everything.filter(kind == "rss"),
        "github": everything.filter(kind.startswith("github")),
        "linkedin": everything.filter(kind == "linkedin"),
    }


RANK = "CASE WHEN content_type = 'rss' THEN 0 WHEN content_type = 'linkedin' THEN 2 ELSE 1 END"
GATHERED = f"gathered AS (SELECT * REPLACE (ord + {RANK} * 1152921504606846976 AS ord) FROM items)"
KEPT = (GATHERED, *survivors_sql("gathered"), "kept AS (SELECT * FROM gathered WHERE ord IN (SELECT ord FROM survivors))")


@add("c04_curate", with_items(
    f"""SELECT *, row_number() OVER (ORDER BY relevance_score DESC, ord) - 1 AS pos FROM (
        SELECT ord, title, {score_sql(scoring.WORKFLOW_PRESET)} AS relevance_score FROM kept
        WHERE category = 'view' AND published_ts >= {AS_OF_SQL} - INTERVAL 2 DAY)""", *KEPT))
def _(spark, sf):
    done = curation.curate(frames(spark, sf), AS_OF, curation.Options(category="view"))
    return number_sorted(done).select("ord", "title", "relevance_score", "pos")


@add("c05_ad_hoc", with_items(
    f"""SELECT ord, title FROM gathered WHERE category = 'view' AND published_ts >= {AS_OF_SQL} - INTERVAL 7 DAY
        AND (contains(lower(title), 'llm') OR contains(lower(coalesce(summary, '')), 'llm'))""", GATHERED))
def _(spark, sf):
    options = curation.Options(category="view", search="LLM")
    return curation.ad_hoc(spark, frames(spark, sf), AS_OF, options)["items"].select("ord", "title")


def save_arrays(items, folder):
    """Write items into the folder as files of one array each."""
    def run(batches):
        before = "["
        for batch in batches:
            for line in batch.column("value").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [before + line]})
                before = ","
        yield pa.RecordBatch.from_pydict({"value": ["]" if before == "," else "[]"]})

    lines = items.select(F.to_json(F.struct("*")).alias("value")).repartition(4)
    lines.mapInArrow(run, "value string").write.mode("append").text(folder)


@add("c05_ad_hoc_loaded", with_items(
    f"""SELECT ord, title FROM (SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM items)
        WHERE category = 'view' AND published_ts >= {AS_OF_SQL} - INTERVAL 7 DAY
        AND (contains(lower(title), 'llm') OR contains(lower(coalesce(summary, '')), 'llm'))"""))
def _(spark, sf):
    """All items, from a folder of line-delimited files and of arrays."""
    folder, items = stage_path(spark, "mixed"), conform(dated_items(spark, sf))
    items.filter("ord % 2 = 0").write.json(folder)
    save_arrays(items.filter("ord % 2 = 1"), folder)
    options = curation.Options(category="view", search="LLM", load=folder)
    return curation.ad_hoc(spark, {}, AS_OF, options)["items"].select("ord", "title")


@add("c05_ad_hoc_digest", with_items(
    HTML_PAGE, GATHERED, f"wanted AS (SELECT * FROM gathered WHERE published_ts >= {AS_OF_SQL} - INTERVAL 7 DAY)",
    html_rows_sql("wanted"), HTML_SECTIONS))
def _(spark, sf):
    return curation.ad_hoc(spark, frames(spark, sf), AS_OF)["digest"]


@add("c06_digest_run", with_items(
    HTML_PAGE, *KEPT, f"wanted AS (SELECT * FROM kept WHERE published_ts >= {AS_OF_SQL} - INTERVAL 2 DAY)",
    html_rows_sql("wanted"), HTML_SECTIONS))
def _(spark, sf):
    return curation.digest_run(frames(spark, sf), AS_OF)


@add("c07_aggregate_all", with_items(
    f"SELECT ord, title, {instant_sql('published_ts')} AS at, row_number() OVER (ORDER BY {NEWEST}) - 1 AS pos FROM kept", *KEPT))
def _(spark, sf):
    done = number_sorted(curation.aggregate_all(frames(spark, sf), AS_OF))
    return done.select("ord", "title", instant_text("published_ts", "at"), "pos")


SHORTENED = f"""CASE WHEN opened AND length({strip_sql("coalesce(summary, '')")}) >= 100
  THEN concat(substr(summary, 1, 150), '...') END"""
OPENED = """opened AS (SELECT *, (SELECT bool_or(coalesce(summary, '') = '' AND length(coalesce(description, '')) >= 50)
  FROM kept) AS opened FROM kept)"""


@add("c07_aggregate_all_summaries", with_items(
    f"SELECT ord, {SHORTENED} AS generated_summary FROM opened", *KEPT, OPENED))
def _(spark, sf):
    done = curation.aggregate_all(frames(spark, sf), AS_OF, summaries=True)
    return done.select("ord", "generated_summary")


# --- streams -----------------------------------------------------------------------------------------


def landed_items(spark, sf) -> str:
    """Folder of JSON items, as a fetch job would leave them."""
    folder = stage_path(spark, "landed")
    conform(dated_items(spark, sf)).write.json(folder)
    return folder


def ingested_in_turn(spark, everything, **limits):
    """Three micro-batches, newest items first, undated ones in the first; the history blocks the later batches."""
    root, folder = stage_path(spark, "ingest"), stage_path(spark, "landed")
    age = F.coalesce(F.datediff(F.lit(AS_OF), "published_ts"), F.lit(0))
    turn = F.when(age < 5, 0).when(age < 10, 1).otherwise(2)
    everything.withColumn("turn", turn).write.partitionBy("turn").json(folder)  # one pass lands them all
    for last in range(3):
        if landed := [n for n in child_names(spark, folder) if n.startswith("turn=") and int(n[5:]) <= last]:
            stream = with_published_ts(ingest.item_stream(spark, f"{folder}/{{{','.join(landed)}}}"))
            ingest.ingest(stream, root, AS_OF, **limits).awaitTermination()
    return ingest.ingested(spark, root).select("ord")


@add("t01_ingest", with_items("SELECT ord FROM survivors", *survivors_sql()))
def _(spark, sf):
    return ingested_in_turn(spark, conform(dated_items(spark, sf)))


@add("t01_ingest_exact", walk_sql("SELECT ord FROM walk WHERE fate = 'kept'"))
def _(spark, sf):
    """With a copy of every item, and thresholds of 1."""
    copied = with_copies(spark, sf).withColumn("published", F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss"))
    return ingested_in_turn(spark, conform(copied), threshold=1.0, alone=1.0)


@add("t02_dedup_stream", with_items(
    f"""SELECT DISTINCT {norm_url_sql('link')} AS norm_url FROM items WHERE link <> '' AND published_ts IS NOT NULL
       UNION ALL SELECT NULL FROM items WHERE link = '' OR published_ts IS NULL"""))
def _(spark, sf):
    root = stage_path(spark, "dedup-stream")
    stream = with_published_ts(ingest.item_stream(spark, landed_items(spark, sf)))
    ingest.run_to_folder(ingest.dedup_stream(stream), root).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("norm_url")


@add("t02_dedup_stream_newest", with_items(
    """SELECT ord, norm_url FROM (SELECT ord, norm_url, row_number() OVER (PARTITION BY norm_url, session ORDER BY published_ts DESC, ord) AS rn
       FROM sessions) WHERE rn = 1 UNION ALL SELECT ord, NULL FROM items WHERE link = '' OR published_ts IS NULL""",
    keyed_sql(),
    """gaps AS (SELECT *, lag(published_ts) OVER (PARTITION BY norm_url ORDER BY published_ts, ord) AS before
       FROM keyed WHERE link <> '' AND published_ts IS NOT NULL)""",
    """sessions AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR published_ts >= before + INTERVAL 24 HOUR)
       OVER (PARTITION BY norm_url ORDER BY published_ts, ord) AS session FROM gaps)"""))
def _(spark, sf):
    """Items arrive in any order; a later row of another time closes all sessions."""
    root, folder = stage_path(spark, "dedup-stream-newest"), landed_items(spark, sf)
    stream = with_published_ts(ingest.item_stream(spark, folder))
    ingest.run_to_folder(ingest.dedup_stream_newest(stream), root).awaitTermination()
    closing = spark.createDataFrame([(-1, "https://closing.example.org/", "2100-01-01 00:00:00")], "ord long, link string, published string")
    closing.write.mode("append").json(folder)
    ingest.run_to_folder(ingest.dedup_stream_newest(with_published_ts(ingest.item_stream(spark, folder))), root).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("ord", "norm_url")


@add("t02_dedup_stream_fingerprint", with_items(
    f"""SELECT DISTINCT {FINGERPRINT} AS fp FROM items WHERE link <> '' AND published_ts IS NOT NULL
       UNION ALL SELECT NULL FROM items WHERE link = '' OR published_ts IS NULL"""))
def _(spark, sf):
    root = stage_path(spark, "dedup-stream-fp")
    stream = with_published_ts(ingest.item_stream(spark, landed_items(spark, sf)))
    ingest.run_to_folder(ingest.dedup_stream_by_fingerprint(stream), root).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("fp")
