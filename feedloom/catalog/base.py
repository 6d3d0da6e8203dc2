"""The items view over the driver's tables, as a DataFrame and as SQL, and the registry helpers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.clock import utc
from feedloom.schema import with_published_ts
from feedloom.session import configure, spread

AS_OF = dt.datetime(2024, 1, 16)
AS_OF_SQL = "TIMESTAMP '2024-01-16 00:00:00'"


@dataclass
class Registry:
    """Named queries with optional SQL."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def register(query):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return query(configure(spark), sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return query

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _title():
    suffix = (
        F.when(F.col("doc_id") % 11 == 0, " Amazon Q").when(F.col("doc_id") % 11 == 3, " copilot and OpenAI")
        .when(F.col("doc_id") % 11 == 5, " LLM code generation").otherwise("")
    )
    return F.concat(F.substring(F.substring_index("text", "\n", 1), 1, 100), suffix)


def _link():
    d = F.col("doc_id")
    tail = (
        F.when(d % 9 < 3, "?utm_source=feed").when(d % 9 < 6, "#top").when(d % 9 == 6, "?page=2&ref=x").otherwise("")
    )
    url = F.concat(F.lit("https://"), "lang", F.lit(".example.org/a/"), (d % 700).cast("string"), tail)
    return F.when(d % 40 == 7, "").otherwise(url)


def _summary():
    d = F.col("doc_id")
    return (
        F.when(d % 97 == 96, F.lit(None))
        .when(d % 10 == 0, F.concat(F.lit("<p>"), "text", F.lit("</p><script>track(1);</script>")))
        .when(d % 10 == 1, F.concat("text", F.lit(" {{ x }} {% y %}")))
        .otherwise(F.col("text"))
    )


def _published():
    d, ts = F.col("doc_id"), F.col("ts")
    day, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss")
    dom = F.date_format(ts, "dd")
    lit = F.lit
    return (
        F.when(d % 8 == 0, F.concat(day, lit("T"), clock, lit("Z")))
        .when(d % 8 == 1, F.concat(day, lit("T"), clock))
        .when(d % 8 == 2, F.concat(day, lit(" "), clock))
        .when(d % 8 == 3, F.concat(lit("Mon, "), dom, lit(" Jan 2024 "), clock, lit(" +0000")))
        .when(d % 8 == 4, F.concat(day, lit("T"), clock, lit("-05:00")))
        .when(d % 8 == 5, F.concat(dom, lit(" Jan 2024 "), clock))
        .when(d % 8 == 6, F.concat(lit("2024/01/"), dom, lit(" "), clock))
        .when(d % 3 == 0, "")
        .otherwise("not a date")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item texts from ``documents`` alone, for queries that need no event."""
    d = F.col("doc_id")
    source = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return source.select(
        d.alias("ord"),
        F.concat(F.lit("doc-"), d.cast("string")).alias("id"),
        _title().alias("title"),
        _link().alias("link"),
        _summary().alias("summary"),
        F.when(d % 61 != 0, F.col("source")).alias("source"),
        F.when(d % 4 == 0, "rss").when(d % 4 == 1, "github_release").when(d % 4 == 2, "github_pr")
        .otherwise("linkedin").alias("content_type"),
        F.when(d % 3 == 0, F.expr("substring(text, 1, cast(doc_id % 300 as int))")).alias("description"),
        "text",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per document: text from ``documents``, time, category and author from its event."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    d = F.col("doc_id")
    joined = documents(spark, sf_dir).withColumn("doc_id", F.col("ord")).drop("text").join(
        events, d * 5 == F.col("event_id")
    )
    return joined.select(
        "ord", "id", "title", "link", "summary",
        utc("ts").alias("published_ts"),
        _published().alias("published"),
        "source",
        F.when(d % 50 != 0, F.col("event_type")).alias("category"),
        "content_type",
        F.when(d % 13 == 0, F.lit(None)).when(d % 13 == 1, "Unknown")
        .otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("author"),
        "description",
    )


def dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose ``published_ts`` comes from the textual ``published``."""
    return with_published_ts(items(spark, sf_dir))


# The same view for the SQL side.
ITEMS_SQL = """
SELECT d.doc_id AS ord,
  concat('doc-', CAST(d.doc_id AS VARCHAR)) AS id,
  concat(substr(split_part(d.text, chr(10), 1), 1, 100),
    CASE d.doc_id % 11 WHEN 0 THEN ' Amazon Q' WHEN 3 THEN ' copilot and OpenAI'
                       WHEN 5 THEN ' LLM code generation' ELSE '' END) AS title,
  CASE WHEN d.doc_id % 40 = 7 THEN '' ELSE concat('https://', d.lang, '.example.org/a/',
    CAST(d.doc_id % 700 AS VARCHAR),
    CASE WHEN d.doc_id % 9 < 3 THEN '?utm_source=feed' WHEN d.doc_id % 9 < 6 THEN '#top'
         WHEN d.doc_id % 9 = 6 THEN '?page=2&ref=x' ELSE '' END) END AS link,
  CASE WHEN d.doc_id % 97 = 96 THEN NULL
       WHEN d.doc_id % 10 = 0 THEN concat('<p>', d.text, '</p><script>track(1);</script>')
       WHEN d.doc_id % 10 = 1 THEN concat(d.text, ' {{ x }} {% y %}')
       ELSE d.text END AS summary,
  e.ts AS event_ts,
  CASE d.doc_id % 8
    WHEN 0 THEN concat(substr(CAST(e.ts AS VARCHAR),1,10), 'T', substr(CAST(e.ts AS VARCHAR),12,8), 'Z')
    WHEN 1 THEN concat(substr(CAST(e.ts AS VARCHAR),1,10), 'T', substr(CAST(e.ts AS VARCHAR),12,8))
    WHEN 2 THEN substr(CAST(e.ts AS VARCHAR),1,19)
    WHEN 3 THEN concat('Mon, ', substr(CAST(e.ts AS VARCHAR),9,2), ' Jan 2024 ', substr(CAST(e.ts AS VARCHAR),12,8), ' +0000')
    WHEN 4 THEN concat(substr(CAST(e.ts AS VARCHAR),1,10), 'T', substr(CAST(e.ts AS VARCHAR),12,8), '-05:00')
    WHEN 5 THEN concat(substr(CAST(e.ts AS VARCHAR),9,2), ' Jan 2024 ', substr(CAST(e.ts AS VARCHAR),12,8))
    WHEN 6 THEN concat('2024/01/', substr(CAST(e.ts AS VARCHAR),9,2), ' ', substr(CAST(e.ts AS VARCHAR),12,8))
    ELSE CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'not a date' END END AS published,
  CASE WHEN d.doc_id % 61 = 0 THEN NULL ELSE d.source END AS source,
  CASE WHEN d.doc_id % 50 = 0 THEN NULL ELSE e.event_type END AS category,
  CASE d.doc_id % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'github_release' WHEN 2 THEN 'github_pr' ELSE 'linkedin' END AS content_type,
  CASE d.doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' ELSE concat('user-', CAST(e.user_id AS VARCHAR)) END AS author,
  CASE WHEN d.doc_id % 3 = 0 THEN substr(d.text, 1, CAST(d.doc_id % 300 AS INT)) ELSE NULL END AS description
FROM documents d JOIN events e ON e.event_id = d.doc_id * 5
"""

# Instant of the published text, one branch per dialect.
PUBLISHED_TS_SQL = """
CASE WHEN published LIKE '%T%-05:00' THEN try_strptime(substr(published, 1, 19), '%Y-%m-%dT%H:%M:%S') + INTERVAL 5 HOUR
     WHEN published LIKE '%T%Z' THEN try_strptime(published, '%Y-%m-%dT%H:%M:%SZ')
     WHEN published LIKE 'Mon, %' THEN try_strptime(substr(published, 6, 20), '%d %b %Y %H:%M:%S')
     WHEN published LIKE '____-__-__T%' THEN try_strptime(published, '%Y-%m-%dT%H:%M:%S')
     WHEN published LIKE '____-%' THEN try_strptime(published, '%Y-%m-%d %H:%M:%S')
     WHEN published LIKE '____/%' THEN try_strptime(published, '%Y/%m/%d %H:%M:%S')
     ELSE try_strptime(published, '%d %b %Y %H:%M:%S') END
"""


def with_items(select: str, *more: str) -> str:
    """SQL over ``items`` (with ``published_ts``), and further named subqueries."""
    ctes = [f"raw_items AS ({ITEMS_SQL})", f"items AS (SELECT *, {PUBLISHED_TS_SQL} AS published_ts FROM raw_items)"]
    return f"WITH {', '.join([*ctes, *more])} {select}"


def instant_text(c, alias: str):
    """Timestamp as UTC text, so that results compare without zone conversions."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias(alias)


def instant_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
