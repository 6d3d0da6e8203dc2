"""Registered queries of the operators over the given tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.catalog.base import Registry
from feedloom.llm import ann, bpe, embed_dedup, langid, licenses, lm, mixing, piece_table, quality, runs, simhash, toxicity, warc
from feedloom.llm.common import bounded_batches, table
from feedloom.llm.oracles import FILL_IN_MIDDLE_SQL, MIXING_SQL, QUALITY_SQL, WARC_SQL
from feedloom.session import stage_path

REGISTRY = Registry()


def word_bpe_path() -> str:
    """The public word BPE tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@REGISTRY.add("op1_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


@REGISTRY.add("op2_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = word_bpe_path()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")
    )
    return bpe.decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@REGISTRY.add("op3_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.add("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@REGISTRY.add("op6_license_scan", licenses.scan_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@REGISTRY.add("op7_warc", WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"), key="page_id", uri="url", text="html"), path)
    read = warc.read_archives(spark, path, payloads=False)
    return read.select(
        warc.key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"), "verified",
    )


@REGISTRY.add("op8_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@REGISTRY.add("op9_mix_sources", MIXING_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.stage(mixing.sized(table(spark, sf_dir, "documents")), "mix-sizes")
    mixed = mixing.apply_plan(sizes, mixing.stage(mixing.mixing_plan(sizes), "mix-plan"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@REGISTRY.add("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return langid.fit_and_predict(table(spark, sf_dir, "documents"))


def repeat_tail(doc_id: str, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with everything from some word on made periodic; the others as they are."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % period] for i in range(n - a)]


@REGISTRY.add("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(docs, key="doc_id", rewrite=repeat_tail).withColumn("best", runs.strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@REGISTRY.add("op12_fill_in_middle", FILL_IN_MIDDLE_SQL)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    arranged = piece_table.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = piece_table.restore(arranged.drop("pieces"))
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@REGISTRY.add("op13_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.fit_and_judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
