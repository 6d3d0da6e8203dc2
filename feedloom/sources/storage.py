"""Item snapshots and stage tables on any file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from feedloom.operators.ranking import dense_positions
from feedloom.schema import ITEM
from feedloom.session import path_exists, publish
from feedloom.sources.json_records import json_records


def _records(spark: SparkSession, path: str, multi_line: bool | None) -> DataFrame:
    """Items with ``_bad``, the text of a record that can't be read, and ``_file``, ``_start`` and ``_place``, where it is."""
    if multi_line is None:
        return json_records(spark, path, ITEM, "_bad")
    schema = T.StructType([*ITEM.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumns({
        "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()
    })


# Spark refuses a query that needs no column but the one of bad records, so the test names another one too.
READABLE = "CASE WHEN _bad IS NOT NULL THEN false ELSE ord IS NULL OR ord >= -4611686018427387904 OR ord < 0 END"


def load_items(spark: SparkSession, path: str, multi_line: bool | None = None, bad: Observation | None = None) -> DataFrame:
    """JSON items; a missing path gives no rows.

    Files may have any layout, also in one folder: an object a line, as ``save_items`` writes them, arrays, indented
    objects. All are split between tasks and read once, when this is called (see ``json_records``); with ``multi_line`` Spark's
    own reader is told the layout and reads when the rows are used. Records that can't be read are left out and, with
    ``bad``, counted as ``bad_records`` while the rows are used. A damaged record costs no other.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], ITEM)
    rows = _records(spark, path, multi_line)
    if bad is not None:
        rows = rows.observe(bad, F.count_if(F.col("_bad").isNotNull()).alias("bad_records"))
    return rows.filter(READABLE).drop("_bad", "_file", "_start", "_place")


def load_ordered_items(spark: SparkSession, path: str, multi_line: bool | None = None, refuse: bool = False) -> DataFrame:
    """``load_items`` with an ``ord`` for every row: 0, 1, 2, … by the ``ord`` they have, then by file and position.

    Records that can't be read are left out or, with ``refuse``, an error that names the file.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], ITEM)
    items = _records(spark, path, multi_line)
    if refuse:
        error = F.raise_error(F.concat(F.lit("unreadable record in "), "_file")).cast("boolean")
        items = items.filter(F.when(F.col("_bad").isNotNull(), error).otherwise(F.expr(READABLE)))
    else:
        items = items.filter(READABLE)
    placed = items.drop("_bad").withColumns({"_no_ord": F.col("ord").isNull()})
    numbered = dense_positions(placed, ["_no_ord", "ord", "_file", "_start", "_place"], "_pos")
    return numbered.withColumn("ord", F.col("_pos")).select(*ITEM.fieldNames())


def save_items(items: DataFrame, root: str, run_ts: str, fmt: str = "json") -> str:
    """Write one snapshot under ``run_ts=…``; writing the same run again replaces it when the new one is whole."""
    path = f"{root}/run_ts={run_ts}"
    publish(items.sparkSession, path, items.write.option("ignoreNullFields", False).format(fmt).save)
    return path


def load_snapshots(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """All snapshots, with ``run_ts`` as a partition column."""
    dated = T.StructType([*ITEM.fields, T.StructField("run_ts", T.StringType())])
    return spark.read.schema(dated).format(fmt).load(root)


def latest_snapshot(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """Rows of the newest run. The run is found by listing folders; older runs are never read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run_ts=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    runs = sorted(status.getPath().getName() for status in (found or []))
    if not runs:
        return spark.createDataFrame([], ITEM)
    return spark.read.schema(ITEM).format(fmt).load(f"{root}/{runs[-1]}")


def store_stage(df: DataFrame, root: str, name: str, run_ts: str) -> str:
    """Hand a frame to a later job as parquet; returns its URI."""
    uri = f"{root}/{name}/run_ts={run_ts}"
    publish(df.sparkSession, uri, df.write.parquet)
    return uri


def retrieve_stage(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(uri)


def save_digest(digest: DataFrame, path: str) -> None:
    """Write the one-row digest as a single text file."""
    publish(digest.sparkSession, path, digest.select(F.col("digest").alias("value")).coalesce(1).write.text)
