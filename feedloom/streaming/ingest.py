"""Incremental ingestion and streaming deduplication."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions.text import text_or_empty
from feedloom.functions.urls import normalise_url
from feedloom.operators.dedup import (
    ALONE, THRESHOLD, WINDOW_HOURS, earliest, fingerprint, key_table, linkless_rows, rule_of, settle, spot, text_digest, url_table,
)
from feedloom.operators.ranking import dense_positions
from feedloom.schema import ITEM
from feedloom.session import stage
from feedloom.streaming.history import BUCKET_ROWS, History


#: Numbers of rows inside a batch have so many bits.
ROW_BITS = 36
#: Rows of a URL that are looked at first, by how many times more when all of them fall, and when all rows are.
FIRST_OF_URL, MORE_OF_URL, MOST_OF_URL = 4, 16, 1024
_THIN = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("batch", T.LongType()),
        T.StructField("at", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("url", "site", "fp", "title_md5", "summary_md5")],
        T.StructField("title_len", T.IntegerType()),
        T.StructField("summary_len", T.IntegerType()),
    ]
)
_TEXTS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType())])
_PARTNERS = T.StructType([*_THIN, T.StructField("title", T.StringType())])
_URLS = T.StructType([T.StructField("url", T.StringType())])


def item_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of line-delimited JSON items landing in a folder."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_batch).json(path)


def _numbered(rows: DataFrame, batch_id: int, as_of) -> DataFrame:
    """``_row, row_id, spot, url`` of rows numbered by ``_row``. ``row_id``: the batch and the row's place by ``ord``, unique
    over all batches and in order of arrival. No texts are moved for it."""
    placed = dense_positions(url_table(rows, as_of, "_row"), ["ord", "_row"], "_number")
    placed = placed.withColumn("row_id", F.col("_number") + F.lit(batch_id << ROW_BITS))
    return placed.select("_row", "row_id", spot(F.lit(batch_id), F.col("at"), F.col("row_id")).alias("spot"), "url")


def _as_items(rows: DataFrame) -> DataFrame:
    """Rows as the batch rule wants them, with ``row_id`` as their ``ord``."""
    return rows.select(F.col("row_id").alias("ord"), "title", "summary", "link", "published_ts")


def _key_rows(thin: DataFrame) -> DataFrame:
    """Stored key columns as a key table; linked rows only."""
    rows = thin.filter(F.col("url").isNotNull()).withColumnRenamed("row_id", "ord")
    order = spot(F.col("batch"), F.col("at"), F.col("ord"))
    return rows.select("ord", "at", order.alias("spot"), "url", "site", "fp", "title_md5", "summary_md5", "title_len", "summary_len")


def _partner_rows(thin: DataFrame) -> DataFrame:
    """All kept rows as partners. Histories of older runs lack the hashes of linkless rows."""
    order = spot(F.col("batch"), F.col("at"), F.col("row_id"))
    title = F.coalesce("title_md5", text_digest(F.lower(text_or_empty("title"))))
    return thin.select(
        F.col("row_id").alias("ord"), "at", order.alias("spot"), F.coalesce("site", F.lit("")).alias("site"),
        title.alias("title_md5"), "summary_md5", "title_len", "summary_len",
    )


def ingest(
    stream: DataFrame, root: str, as_of, curate: Callable[[DataFrame], DataFrame] | None = None, *, bucket_rows: int = BUCKET_ROWS,
    threshold: float = THRESHOLD, window_hours: float = WINDOW_HOURS, alone: float = ALONE,
) -> StreamingQuery:
    """Start the incremental job: drop what repeats a kept row of this or an earlier batch, keep the rest.

    The rule is that of one pass over the batches in turn, each newest first, ties by ``ord``, which must be unique inside a
    batch: a row falls to a kept row with its URL or, where a kept row has its fingerprint, to any kept row that it resembles.
    Where the cut between batches falls makes no difference to items that arrive newest first.

    What a batch reads of the history (see ``History``) are the URLs in the folders of its own URLs, and the thin key columns
    in the folders of its own fingerprints. Texts are read from these folders for rows whose lengths and hashes leave the
    question open, and the whole history only for a row that shares its fingerprint with a kept row and resembles none of its
    group, which is rare.

    Rows whose URL the history has fall at once. Of the others the first few of each URL are looked at: if one of them is kept,
    all rows of the URL after it fall to it and block nothing, so neither their texts nor their fingerprints count. Where all
    of them fall, more rows of the URL are looked at, and the rule is run again over all that have been.

    ``curate`` may filter or score the rows before they are compared. A replayed batch replaces its own result.
    """
    rule = rule_of(threshold, window_hours, alone)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history = History(spark, root, batch_id, bucket_rows)
        turn = F.lit(batch_id)
        rows = stage((curate(batch) if curate else batch).withColumn("_row", F.monotonically_increasing_id()), "batch-rows")
        numbered = _numbered(rows, batch_id, as_of)
        seen = history.read("urls", _URLS, numbered.filter("url IS NOT NULL"), "url").distinct()
        unread = stage(numbered.join(seen, "url", "left_anti").select(*numbered.columns), "batch-open")
        near = earliest(unread.filter("url IS NOT NULL"), "url", FIRST_OF_URL).drop("rn").unionByName(unread.filter("url IS NULL"))
        read = found = None
        looked_at = FIRST_OF_URL
        while True:
            # Few rows as a rule, and known to be few once staged: the texts stay where they are.
            near = stage(near.select("_row", "row_id"), "batch-near")
            texts = stage(rows.join(near, "_row").drop("_row"), "batch-texts")
            keys = stage(key_table(_as_items(texts), as_of, turn), "batch-keys")
            read = texts if read is None else read.unionByName(texts)
            found = keys if found is None else found.unionByName(keys)
            items = _as_items(read)
            kept = history.read("items", _THIN, found, "fp").join(found.select("fp").distinct(), "fp", "left_semi")
            both = stage(found.unionByName(_key_rows(kept)), "batch-and-kept")
            own = items.select("ord", "title", "summary")
            old, whole = history.read("items", _TEXTS, found, "fp"), history.read("items", _TEXTS)
            always = linkless_rows(items, as_of, turn).unionByName(_partner_rows(history.read("items", _PARTNERS)))
            dropped = settle(
                own.unionByName(old.withColumnRenamed("row_id", "ord")), both, always, rule, reasons=False,
                judged=F.col("spot.back_turn") == -batch_id, all_items=own.unionByName(whole.withColumnRenamed("row_id", "ord")),
            )
            linked = stage(found.join(dropped.select("ord"), "ord", "left_anti"), "batch-linked")
            unread = unread.filter("url IS NOT NULL").join(near, "_row", "left_anti").select(*numbered.columns)
            waiting = unread.join(linked.select("url"), "url", "left_anti").select(*numbered.columns)
            if waiting.isEmpty():
                break
            looked_at *= MORE_OF_URL
            near = earliest(waiting, "url", looked_at) if looked_at <= MOST_OF_URL else unread
        linkless = linkless_rows(items, as_of, turn).select(
            F.col("ord").alias("row_id"), "at", *[F.lit(None).cast(_THIN[c].dataType).alias(c) for c in ("url", "site", "fp")],
            "title_md5", "summary_md5", "title_len", "summary_len",
        )
        thin = linked.withColumnRenamed("ord", "row_id").select(*linkless.columns).unionByName(linkless).withColumn("batch", turn.cast("long"))
        fresh = stage(read.drop(*(set(thin.columns) - {"row_id"})).join(thin, "row_id"), "batch-kept")
        history.add("items", fresh, "fp")
        history.add("urls", stage(fresh.filter("url IS NOT NULL").select("url"), "batch-urls"), "url")
        history.commit()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingested(spark: SparkSession, root: str) -> DataFrame:
    """Everything the incremental job has kept; without a finished batch, no rows of the item record."""
    segments = [spark.read.parquet(path) for path, _ in History(spark, root).folders("items")]
    if not segments:
        return spark.createDataFrame([], ITEM)
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), segments)
    return rows.drop(*_THIN.fieldNames(), "bucket")


def _first_arrivals(stream: DataFrame, name: str, key, window: str) -> DataFrame:
    """First arrival of every key within the watermark, and every row that has no link or no time.

    Such rows have nothing to compare, or no time that would bound the state: they pass, with a null key.
    """
    bounded = F.coalesce((text_or_empty("link") != "") & F.col("published_ts").isNotNull(), F.lit(False))
    keyed = stream.filter(bounded).withColumn(name, key).withWatermark("published_ts", window)
    return keyed.dropDuplicatesWithinWatermark([name]).union(stream.filter(~bounded).withColumn(name, F.lit(None).cast("string")))


def dedup_stream(stream: DataFrame, window: str = "24 hours") -> DataFrame:
    """First arrival of every normalised URL (``norm_url``) within the watermark; state expires with it.

    Key-only and first-arrival, unlike the batch rule, which compares texts and keeps the newest. Rows without a link or
    a time pass.
    """
    return _first_arrivals(stream, "norm_url", normalise_url("link"), window)


def dedup_stream_by_fingerprint(stream: DataFrame, window: str = "24 hours") -> DataFrame:
    """First arrival of every fingerprint (``fp``) within the watermark; rows without a link or a time pass."""
    return _first_arrivals(stream, "fp", fingerprint(), window)


def dedup_stream_newest(stream: DataFrame, window: str = "24 hours") -> DataFrame:
    """The newest row of every normalised URL (``norm_url``) among rows less than ``window`` apart, whenever they arrive.

    Rows of a URL form sessions by event time; a session's newest row, ties by the smallest ``ord``, is emitted when the
    watermark, ``window`` behind, has passed its end, so a late row counts as long as its session is open. Rows without a
    link or a time pass at once, with a null key.
    """
    bounded = F.coalesce((text_or_empty("link") != "") & F.col("published_ts").isNotNull(), F.lit(False))
    keyed = stream.filter(bounded).withColumn("norm_url", normalise_url("link")).withWatermark("published_ts", window)
    fields = [F.col(c) for c in stream.columns]
    newest = F.max_by(F.struct(*fields), F.struct("published_ts", -F.col("ord")))
    sessions = keyed.groupBy(F.session_window("published_ts", window), "norm_url").agg(newest.alias("row"))
    rest = stream.filter(~bounded).withColumn("norm_url", F.lit(None).cast("string"))
    return sessions.select("row.*", "norm_url").union(rest)


def run_to_folder(stream: DataFrame, root: str) -> StreamingQuery:
    """Append a stream's rows to ``root/rows`` and stop when the input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
