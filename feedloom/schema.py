"""The item record every source is projected to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedloom.functions.dates import parse_published

_STRING, _LONG, _TS = T.StringType(), T.LongType(), T.TimestampType()

ITEM = T.StructType(
    [
        T.StructField("ord", _LONG),
        T.StructField("id", _STRING),
        T.StructField("title", _STRING),
        T.StructField("link", _STRING),
        T.StructField("summary", _STRING),
        T.StructField("published", _STRING),
        T.StructField("published_ts", _TS),
        T.StructField("source", _STRING),
        T.StructField("category", _STRING),
        T.StructField("content_type", _STRING),
        T.StructField("author", _STRING),
        T.StructField("fetched_at", _TS),
        T.StructField("thumbnail", _STRING),
        T.StructField("views", _STRING),
        T.StructField("likes", _STRING),
        T.StructField("comments", _STRING),
        T.StructField("description", _STRING),
        T.StructField("relevance_score", T.IntegerType()),
        T.StructField("generated_summary", _STRING),
        T.StructField("ai_summary", _STRING),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """Project to the item record: absent fields are null, others are cast."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ITEM.fields
        ]
    )


def with_published_ts(df: DataFrame) -> DataFrame:
    """Derive ``published_ts`` from the textual ``published``."""
    return df.withColumn("published_ts", parse_published("published"))


def newest_first(lexical: bool = False) -> list[Column]:
    """Stable newest-first sort keys; ``lexical`` compares the raw strings instead of the instants."""
    key = F.coalesce("published", F.lit("")).desc() if lexical else F.col("published_ts").desc_nulls_last()
    return [key, F.col("ord").asc()]
