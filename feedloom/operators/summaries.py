"""Batch summarising with a pluggable callable, and its cache."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from feedloom.functions.text import content_hash, fallback_summary, holds_at_least, prepare_for_summary, text_or_empty
from feedloom.operators.filters import batch_gate, needs_summary, summary_route
from feedloom.session import path_exists, stage

Summariser = Callable[[list[str]], list[str]]


def _call(work: DataFrame, summarise: Summariser, rows_per_call: int) -> DataFrame:
    """Run the callable over (hash, text) in small lists; a failing list yields null summaries and the error."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("hash", "generated", "error")])

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), rows_per_call):
                part = batch.iloc[start : start + rows_per_call]
                try:
                    summaries, error = list(summarise(part["text"].tolist())), None
                    if len(summaries) != len(part):
                        raise ValueError(f"{len(summaries)} summaries for {len(part)} texts")
                except Exception as failure:  # one bad list must not lose the batch
                    summaries, error = [None] * len(part), f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame({"hash": part["hash"].to_numpy(), "generated": summaries, "error": error})

    return work.mapInPandas(run, schema)


_RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("hash", "generated", "error")])


def _call_logged(work: DataFrame, summarise: Summariser, rows_per_call: int, log: str, waves: int) -> DataFrame:
    """As ``_call``, in waves that are appended to a log; what the log has is not called again, failed lists are.

    A wave counts when its job ends, so a run that is killed loses the calls of one wave.
    """
    spark = work.sparkSession
    logged = lambda: spark.read.schema(_RESULT).parquet(log) if path_exists(spark, log) else spark.createDataFrame([], _RESULT)
    # Written once: each wave, and the look-up in the log, would work out all texts and hashes again.
    missing = work = stage(work, "summary-work")
    if path_exists(spark, log):
        missing = stage(work.join(logged().filter("error IS NULL").select("hash"), "hash", "left_anti"), "summary-missing")
    for wave in range(waves):
        part = missing.filter(F.pmod(F.xxhash64("hash"), F.lit(waves)) == wave)
        _call(part, summarise, rows_per_call).write.mode("append").parquet(log)
    best = F.max_by(F.struct("generated", "error"), F.struct(F.col("error").isNull(), "generated"))
    return logged().join(work.select("hash"), "hash", "left_semi").groupBy("hash").agg(best.alias("r")).select("hash", "r.*")


def batch_summarise(
    items: DataFrame,
    summarise: Summariser | None = None,
    cache: DataFrame | None = None,
    pages: DataFrame | None = None,
    content: str = "summary",
    link: str = "link",
    gate: str = "any",
    batch: str = "batch_index",
    rows_per_call: int = 3,
    max_length: int = 150,
    log: str | None = None,
    waves: int = 8,
) -> DataFrame:
    """Add ``generated_summary`` to the eligible rows of each batch (see ``batch_gate``).

    Long content is summarised itself; for short content with a link, the text of the link's page is taken
    from ``pages(link, text)`` when given. A text that occurs many times is summarised once: distinct hashes
    go through the cache and the callable, and results are joined back. Without a callable the summary is the
    prefix form of ``fallback_summary``, computed natively. Other rows pass through unchanged; a failed call
    leaves its rows without a summary and says why in ``summary_error``. With ``log``, a folder, results are kept there by
    hash as they come, in ``waves`` jobs, and a later run calls for missing texts only, also after one that was killed.
    """
    # What a summary takes of the content is worked out before the rows meet in their batches, so that the content needn't go along.
    before = {"_route": summary_route(content, link), "_prefix": fallback_summary(content, max_length), "_hash": content_hash(content)}
    gated = batch_gate(items.withColumns(before), needs_summary(), gate, batch)
    routed = gated.withColumn("route", F.when(F.col("eligible"), F.col("_route")))
    if pages is not None:
        # A page landed more than once counts once, whichever order the copies are read in.
        landed = pages.groupBy(F.col(link).alias("_link")).agg(F.min("text").alias("_page"))
        # Rows that need no page get a key of their own, so they do not pile up under one link.
        wanted = F.when(F.col("route") == "url", F.col(link)).otherwise(F.concat(F.lit("row-"), F.col("ord").cast("string")))
        routed = routed.withColumn("_link", wanted).join(landed, "_link", "left").drop("_link")
    else:
        routed = routed.withColumn("_page", F.lit(None).cast("string"))
    from_content, from_page = F.col("route") == "content", F.col("route") == "url"
    prefix = F.when(from_content, F.col("_prefix")).when(from_page & F.col("_page").isNotNull(), fallback_summary("_page", max_length))
    if summarise is None:
        made = routed.withColumns({"_made": prefix, "summary_error": F.lit(None).cast("string")})
        return _finish(made, content, link)

    # The content is long, or it wouldn't be the source.
    long_enough = from_content | (from_page & holds_at_least("_page", 100))
    routed = routed.withColumn("_long", F.coalesce(long_enough, F.lit(False)))
    text_hash = F.when(from_content, F.col("_hash")).otherwise(content_hash("_page"))
    # Rows without a call get a key of their own, so they do not pile up under null in the join.
    own_key = F.concat(F.lit("row-"), F.col("ord").cast("string"))
    routed = routed.withColumn("hash", F.when(F.col("_long"), text_hash).otherwise(own_key))
    work = (
        routed.filter("_long")
        .withColumn("_text", F.when(from_content, F.col(content)).otherwise(F.col("_page")))
        .groupBy("hash").agg(F.any_value("_text").alias("_text"))
        .select("hash", prepare_for_summary("_text").alias("text"))
    )
    known = None
    if cache is not None:
        known = cache.select("hash", F.col("summary").alias("generated"), F.lit(None).cast("string").alias("error"))
        work = work.join(known.select("hash"), "hash", "left_anti")
    # Written once: a call is dear, and a lost executor must not repeat the finished ones.
    if log is None:
        results = stage(_call(work, summarise, rows_per_call), "summaries")
    else:
        results = stage(_call_logged(work, summarise, rows_per_call, log, waves), "summaries")
    results = results if known is None else results.unionByName(known)
    joined = routed.join(results, "hash", "left").withColumnRenamed("error", "summary_error")
    short = F.when(~F.col("_long") & from_page, F.col("_page"))
    failed = F.when(F.col("summary_error").isNotNull(), prefix)
    return _finish(joined.withColumn("_made", F.coalesce("generated", failed, short)).drop("generated", "hash"), content, link)


def _finish(made: DataFrame, content: str, link: str) -> DataFrame:
    """The summaries, with ``summary_key``: the cache key of what was summarised, null where nothing was."""
    key = F.when(F.col("route") == "url", content_hash(link)).when(F.col("route") == "content", content_hash(content))
    done = made.withColumns({
        "generated_summary": F.coalesce("_made", "generated_summary"),
        "summary_key": F.when(F.col("_made").isNotNull() & F.col("summary_error").isNull(), key),
    })
    return done.drop("_made", "_route", "_prefix", "_hash", "_page", "_long", "eligible", "route")


def fresh_cache_rows(summarised: DataFrame, version) -> DataFrame:
    """Cache rows (hash, summary, version) of what ``batch_summarise`` made, one for each ``summary_key``: the hash of the
    content or, for the text of a page, of its link. Failed and inherited summaries are left out."""
    filled = (text_or_empty("generated_summary") != "") & F.col("summary_key").isNotNull()
    return (
        summarised.filter(filled)
        .groupBy(F.col("summary_key").alias("hash"))
        .agg(F.min("generated_summary").alias("summary"))
        .withColumn("version", F.lit(version))
    )


def publish_summaries(df: DataFrame) -> DataFrame:
    """Copy non-empty generated summaries to ``ai_summary``."""
    filled = F.nullif(F.col("generated_summary"), F.lit(""))
    return df.withColumn("ai_summary", F.coalesce(filled, F.col("ai_summary")))
