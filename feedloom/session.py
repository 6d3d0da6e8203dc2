"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: UTC clock and adaptive, skew-aware joins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with its executor, so an unset folder is an error there.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a shared folder before running iterative operators")
    folder = tempfile.mkdtemp(prefix="feedloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _stage_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/feedloom/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier stage has used."""
    return f"{_stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet stage table and read it back: cuts lineage and prunes columns."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def absolute_path(spark: SparkSession, path: str) -> str:
    """The path with its file system and without relative parts."""
    files, target = _file_system(spark, path)
    return files.makeQualified(target).toString().rstrip("/")


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if it doesn't exist."""
    files, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a file or folder another name in place of what has that name."""
    files, old = _file_system(spark, source)
    _, new = _file_system(spark, target)
    files.delete(new, True)
    if not files.rename(old, new):
        raise OSError(f"can't rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name first, so that it is there whole or not at all."""
    files, target = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, target.toString(), path)


def publish(spark: SparkSession, path: str, write) -> None:
    """Run ``write(folder)`` for a folder beside ``path`` that readers overlook, and put it in the place of ``path`` when it is
    whole. A job that fails or is killed while writing leaves what was there."""
    parent, _, name = path.rstrip("/").rpartition("/")
    folder = f"{parent}/_writing-{name.replace('=', '-')}-{uuid.uuid4().hex}"
    try:
        write(folder)
        move(spark, folder, path)
    finally:
        remove(spark, folder)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    files, target = _file_system(spark, path)
    source = files.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables. Call it when no frame that reads them is needed any more."""
    files, target = _file_system(spark, _stage_folder(spark))
    files.delete(target, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan over the cores when it has fewer partitions than there are cores.

    A file of one row group is read by one task. At scale the scan has far more partitions than cores
    and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
