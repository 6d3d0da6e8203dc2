"""The summary cache as a table that grows: rows lie in folders by the hash of their key, and a write touches only the
folders whose rows change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedloom.operators.joins import cache_upsert
from feedloom.session import path_exists, stage

BUCKETS = 256
CACHE = T.StructType(
    [T.StructField("hash", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("version", T.LongType())]
)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int")


def _named(rows: DataFrame) -> list[int]:
    """Folders that the rows belong to, at most ``BUCKETS``."""
    return [r.bucket for r in rows.select(_bucket().alias("bucket")).distinct().collect()]


def read_cache(spark: SparkSession, root: str, keys: DataFrame | None = None) -> DataFrame:
    """``hash, summary, version`` of the cache; with ``keys``, rows with a ``hash``, of the folders that hold them. A cache that
    was never written has no rows."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(T.StructType([*CACHE.fields, T.StructField("bucket", T.IntegerType())])).parquet(root)
    return (rows if keys is None else rows.filter(F.col("bucket").isin(_named(keys)))).select(*CACHE.fieldNames())


def write_cache(root: str, fresh: DataFrame) -> int:
    """Put ``fresh(hash, summary, version)`` into the cache, the highest version of a hash winning; returns the number of
    folders written anew. Folders in which nothing changes keep their files, so a repeated write does nothing."""
    spark = fresh.sparkSession
    fresh = stage(fresh.select(*[F.col(f.name).cast(f.dataType) for f in CACHE.fields]), "cache-fresh")
    old = read_cache(spark, root, fresh)
    merged = stage(cache_upsert(old, fresh), "cache-merged")
    changed = _named(merged.exceptAll(old))
    if changed:
        rows = merged.withColumn("bucket", _bucket()).filter(F.col("bucket").isin(changed)).repartition("bucket")
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(root)
    return len(changed)
