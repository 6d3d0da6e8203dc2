"""Mix sources to target weights by Pareto order sampling. DataFrame operations only.

Each source has a target number of words. Its rate, target over size, gives every document that many whole copies
for certain and leaves a fraction, the inclusion probability of one copy more. Documents are ranked by the odds of a
uniform number over the odds of inclusion, and a fixed amount of words is taken in that order. The uniform number is
a hash of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.session import stage

from feedloom.llm.common import number_key, text_or_empty, word_count

#: Ranks are cut at a bucket of a bucket, so that only a millionth of a source is ordered row by row.
BUCKETS = 1024
HASH_BITS = 52


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code point order, null last, have the weights in turn and split ``share`` of all words by them. A target
    stops at ``most`` times its source's size, and what is left over is shared by the others in the same way. A source's
    bound divided by its weight is the level at which it is full; sources are full in the order of these levels. The
    windows hold one row for each source, never the documents.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    sources = sources.withColumn("full_at", F.col("bound") / F.col("weight"))
    full = F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    sources = sources.withColumn("level", (budget - full) / waiting)
    last = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(everything)
    sources = sources.withColumn("last", last)
    open_ = F.col("last").isNotNull() & (F.col("full_at") >= F.col("last.full_at"))
    target = F.when(open_, F.least(F.col("bound"), F.col("weight") * F.col("last.level"))).otherwise(F.col("bound"))
    return sources.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1, never either, from a hash of the seed and the key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, HASH_BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))


def _ranked(docs: DataFrame, targets: DataFrame, key: str, seed: str) -> DataFrame:
    """Documents with their source's row of ``targets`` and ``rank_odds``, null where no copy is left to chance."""
    doc, src = docs.alias("d"), targets.alias("t")
    joined = doc.join(src, F.col("d.source").eqNullSafe(F.col("t.source")), "left").select("d.*", *[f"t.{c}" for c in targets.columns if c != "source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("copies_for_certain", F.floor(rate)).withColumn("p", rate - F.floor(rate)).withColumn("u", uniform(F.col(key), seed))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return joined.withColumn("rank_odds", F.when(F.col("p") > 0, odds)).withColumn("rank_key", F.coalesce(number_key(docs, key), F.lit(-(1 << 63)))).drop("p", "u")


def _cut(rows: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """For each group the bucket in which the words left to take run out, and the words still left at its start."""
    sums = rows.groupBy(*group, "left_over", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy(*group).orderBy("bucket"))
    sums = sums.withColumn("ahead", ahead).where(F.col("ahead") > F.col("left_over"))
    first = sums.groupBy(*group).agg(F.min(F.struct("bucket", (F.col("left_over") - F.col("ahead") + F.col("words")).alias("left"))).alias("x"))
    return first.select(*group, F.col("x.bucket").alias("bucket"), F.col("x.left").alias("left"))


def mixing_plan(docs: DataFrame, *, key: str = "doc_id", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix:") -> DataFrame:
    """One row for each source: its size and target, and the rank up to which documents get one copy more.

    ``docs`` has ``key``, ``source`` and ``size``. Of the ranked documents those are taken that fit into the words left
    over after whole copies; the gap that remains goes to the one document not taken whose size is nearest to it, if
    that comes nearer to the target. Rows that share a key are taken together or not at all. Every aggregate combines
    before its shuffle, so a source that holds a third of the rows is spread over all tasks.
    """
    targets = stage(source_targets(docs.select("source", "size"), weights, share, most), "mix-targets")
    ranked = _ranked(docs.select(key, "source", "size"), targets, key, seed).where(F.col("rank_odds").isNotNull())
    ranked = ranked.withColumn("source", F.struct("source")).withColumn("left_over", F.col("target") - F.col("copies_for_certain") * F.col("source_size"))
    spot = F.col("rank_odds") / (1 + F.col("rank_odds")) * BUCKETS
    ranked = ranked.select("source", "size", "rank_odds", "rank_key", "left_over", F.floor(spot).alias("b1"), F.floor((spot - F.floor(spot)) * BUCKETS).alias("b2"))
    first = stage(_cut(ranked, ["source"], F.col("b1")).select("source", F.col("bucket").alias("b1"), F.col("left").alias("left_over")), "mix-first")
    inner = ranked.drop("left_over").join(first, ["source", "b1"])
    second = stage(_cut(inner, ["source", "b1"], F.col("b2")).select("source", "b1", F.col("bucket").alias("b2"), F.col("left").alias("left_over")), "mix-second")
    last = ranked.drop("left_over").join(second, ["source", "b1", "b2"]).groupBy("source", "left_over", "rank_odds", "rank_key").agg(F.sum("size").alias("size"))
    ahead = F.sum("size").over(Window.partitionBy("source").orderBy("rank_odds", "rank_key"))
    last = last.withColumn("ahead", ahead).where(F.col("ahead") > F.col("left_over"))
    start = last.groupBy("source").agg(F.min(F.struct("rank_odds", "rank_key", (F.col("left_over") - F.col("ahead") + F.col("size")).alias("gap"))).alias("stop"))
    start = stage(start.select("source", F.col("stop.rank_odds").alias("stop_odds"), F.col("stop.rank_key").alias("stop_key"), F.col("stop.gap").alias("gap")), "mix-stops")
    rest = ranked.groupBy("source", "rank_odds", "rank_key").agg(F.sum("size").alias("size")).join(start, "source")
    rest = rest.where(~_before("rank_odds", "rank_key", "stop_odds", "stop_key")).where("size < 2 * gap")
    best = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank_odds", "rank_key")).alias("fill"))
    ends = start.join(best, "source", "left").select(F.col("source.source").alias("source"), "stop_odds", "stop_key", F.col("fill.rank_odds").alias("fill_odds"), F.col("fill.rank_key").alias("fill_key"))
    t, e = targets.alias("t"), ends.alias("e")
    return t.join(e, F.col("t.source").eqNullSafe(F.col("e.source")), "left").select("t.*", "stop_odds", "stop_key", "fill_odds", "fill_key")


def _before(odds: str, key: str, stop_odds: str, stop_key: str) -> Column:
    return (F.col(odds) < F.col(stop_odds)) | ((F.col(odds) == F.col(stop_odds)) & (F.col(key) < F.col(stop_key)))


def apply_plan(docs: DataFrame, plan: DataFrame, *, key: str = "doc_id", seed: str = "mix:") -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies``, decided row by row from the plan's one row for its source."""
    ranked = _ranked(docs, plan, key, seed)
    filled = F.coalesce((F.col("rank_odds") == F.col("fill_odds")) & (F.col("rank_key") == F.col("fill_key")), F.lit(False))
    before = F.coalesce(_before("rank_odds", "rank_key", "stop_odds", "stop_key"), F.lit(False))
    copies = F.col("copies_for_certain") + (before | filled).cast("long")
    return ranked.select(*docs.columns, "source_size", "target", copies.cast("long").alias("copies"))


def sized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, source, size`` with the number of words as size; a null text has none."""
    return docs.select(key, "source", word_count(text_or_empty()).alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents mixed to their sources' targets: each row as often as the plan takes it, with the columns of ``docs``.

    Null sources are one source of their own, the last. Documents without words are taken like others of their source.
    An empty table gives an empty mix. The texts are read for their sizes, and once more for the result; they are never
    shuffled.
    """
    key, seed = options.get("key", "doc_id"), options.get("seed", "mix:")
    plan = stage(mixing_plan(stage(sized(docs, key), "mix-sizes"), **options), "mix-plan")
    spare = "_mix"
    while spare in docs.columns:
        spare += "_"
    thin = docs.select(F.struct(*docs.columns).alias(spare), F.col(key), F.col("source"))
    taken = apply_plan(thin, plan, key=key, seed=seed)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").select(spare, copies).select(f"{spare}.*")
