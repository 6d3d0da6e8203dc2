"""Feed entries to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedloom.clock import instant
from feedloom.functions.dates import parse_published
from feedloom.functions.text import sanitise_text, text_or_empty
from feedloom.operators.filters import valid_items
from feedloom.operators.ranking import dense_positions

_STRING = T.StringType()

# Raw entries of RSS documents.
RSS_ENTRY = T.StructType(
    [T.StructField(n, _STRING) for n in ("guid", "title", "link", "description", "author", "dc:creator", "pubDate", "dc:date")]
)

# Raw entries of Atom documents.
_LINK = T.StructType([T.StructField(n, _STRING) for n in ("_href", "_rel")])
_PERSON = T.StructType([T.StructField("name", _STRING)])
ATOM_ENTRY = T.StructType(
    [T.StructField(n, _STRING) for n in ("id", "title", "summary", "content", "published", "updated")]
    + [T.StructField("link", T.ArrayType(_LINK)), T.StructField("author", T.ArrayType(_PERSON))]
)

DATE_FIELDS = ("published", "updated", "created")


def _iso(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")


def entry_date(as_of) -> Column:
    """First parsed of published, updated, created as ISO text, else the first raw one, else ``as_of``."""
    parsed = [_iso(F.col(f"{f}_parsed")) for f in DATE_FIELDS]
    raw = [F.nullif(F.col(f), F.lit("")) for f in DATE_FIELDS]
    return F.coalesce(*parsed, *raw, _iso(instant(as_of)))


def normalise_entries(entries: DataFrame, as_of) -> DataFrame:
    """Parsed entries, already joined with their source's name and category, as valid items.

    Reads ord, id, title, link, summary, description, author, authors[].name, the three dates in raw and
    parsed form, source_name and source_category.
    """
    first_author = F.try_element_at(F.col("authors"), F.lit(1))["name"]
    author = F.when(F.col("author").isNotNull(), sanitise_text("author")).otherwise(
        F.when(F.size("authors") > 0, sanitise_text(first_author)).otherwise("Unknown")
    )
    items = entries.select(
        "ord",
        F.coalesce("id", "link", F.lit("")).alias("id"),
        sanitise_text(F.coalesce("title", F.lit("No title"))).alias("title"),
        text_or_empty("link").alias("link"),
        sanitise_text(F.coalesce("summary", "description")).alias("summary"),
        entry_date(as_of).alias("published"),
        F.col("source_name").alias("source"),
        F.coalesce("source_category", F.lit("uncategorized")).alias("category"),
        F.lit("rss").alias("content_type"),
        author.alias("author"),
        instant(as_of).alias("fetched_at"),
    )
    return valid_items(items).withColumn("published_ts", parse_published("published"))


def _placed(raw: DataFrame) -> DataFrame:
    """``ord`` from file and position: the same however the files are split, as the reader keeps their order."""
    placed = raw.withColumns(
        {"file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()}
    )
    return dense_positions(placed, ["file", "_start", "_place"], "ord").drop("_start", "_place")


def read_rss(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Landed RSS documents as parsed entries, with the file they came from and ``ord``, their place among all.

    ``dc:creator`` and ``dc:date`` stand in for a missing author and date. Large documents are split between tasks.
    """
    raw = _placed(spark.read.format("xml").option("rowTag", row_tag).schema(RSS_ENTRY).load(path))
    none = F.lit(None)
    date = F.coalesce(F.nullif(F.col("pubDate"), F.lit("")), F.col("`dc:date`"))
    return raw.withColumn("published", date).select(
        "ord",
        F.col("guid").alias("id"), "title", "link", F.col("description").alias("summary"), "description",
        F.coalesce("author", "`dc:creator`").alias("author"),
        none.cast("array<struct<name:string>>").alias("authors"),
        "published", none.cast("string").alias("updated"),
        none.cast("string").alias("created"),
        parse_published("published").alias("published_parsed"), none.cast("timestamp").alias("updated_parsed"),
        none.cast("timestamp").alias("created_parsed"),
        "file",
    )


def read_atom(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Landed Atom documents as parsed entries, like ``read_rss``. The link is the alternate one, else the first."""
    raw = _placed(spark.read.format("xml").option("rowTag", row_tag).schema(ATOM_ENTRY).load(path))
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    href = F.coalesce(F.try_element_at(alternate, F.lit(1))["_href"], F.try_element_at("link", F.lit(1))["_href"])
    none = F.lit(None)
    return raw.select(
        "ord", "id", "title", href.alias("link"), F.coalesce("summary", "content").alias("summary"), F.col("content").alias("description"),
        none.cast("string").alias("author"), F.col("author").alias("authors"),
        "published", "updated", none.cast("string").alias("created"),
        parse_published("published").alias("published_parsed"), parse_published("updated").alias("updated_parsed"),
        none.cast("timestamp").alias("created_parsed"),
        "file",
    )
