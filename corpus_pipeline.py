"""A corpus from raw documents: toxicity, language, near-duplicates, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and returns the columns of
``documents``, the last one the tokens. ``run`` writes each result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.llm import bpe, langid, mixing, simhash, toxicity
from feedloom.llm.common import bounded_batches, table
from feedloom.llm.queries import word_bpe_path
from feedloom.session import configure, stage


def _beside(docs: DataFrame) -> DataFrame:
    """``row``, a document with all its columns, beside its text, so that no added column clashes with one of its own."""
    return docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't find toxic. A null or empty
    text is judged by the share of toxic texts alone and stays."""
    bounded_batches(spark)
    model = toxicity.fit(stage(toxicity.training_rows(docs, table(spark, sf_dir, "labels")), "toxicity-sample"))
    return toxicity.score(_beside(docs), model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language; those without a letter, null and empty texts too, or unlike all texts
    learned from, go. Learned from the documents' own languages; if none states one, all documents with a letter stay."""
    bounded_batches(spark)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.fit(known.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"), "text"))
    return langid.predict(_beside(docs), model).where(~F.col("rejected")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, of repeated ids any one. All null and empty
    texts are one group. Rows without an id take part, and stay only where no other of their group has one."""
    bounded_batches(spark)
    numbered = stage(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "pipeline-numbered")
    groups = simhash.near_duplicates(numbered.select("number", "row.doc_id", "row.text"), row="number")
    return numbered.join(groups.where("kept").select("number"), "number", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. Null sources are one source; a null text
    has no words and is taken like others of its source."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded_sha256``: the tokens of every document, and a digest of the text
    that they decode to. A null or empty text has no tokens; repeated rows give equal ones."""
    bounded_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), word_bpe_path(), decoded="decoded")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

#: Classifiers and BPE can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
