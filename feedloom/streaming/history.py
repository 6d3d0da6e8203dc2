"""Rows kept by earlier batches, looked up by key without reading the rest.

A table is a set of segments. Each batch adds one; when eight of a size are there, they become one of the next size, so a
table of n batches has some 8 log8(n) segments and a row is rewritten log8(n) times. Inside a segment rows lie in folders by
the first bits of their key's hash, as many as keep a folder to ``BUCKET_ROWS``. A lookup opens the folders of its own keys
only: what it reads grows with its keys and the number of segments, not with the rows kept.

A manifest for each batch names the segments that hold after it. It is written last, under another name first, so a batch
counts whole or not at all; a replayed batch starts from the manifest before its own.
"""

from __future__ import annotations

import functools
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedloom.session import child_names, read_text, remove, write_text

BUCKET_ROWS = 1 << 18
#: Segments of a size that are merged into one.
FAN = 8
#: Digits of a batch number in names, so that they sort.
DIGITS = 12


def _hash(key: str) -> Column:
    """Hash of the key; rows without one are never looked up and are dealt out over all folders."""
    return F.when(F.col(key).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(key))


def _bucket(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(_hash(key), 64 - bits).cast("int") if bits else F.lit(0)


class History:
    """The tables under ``root`` as batch ``batch_id`` finds them."""

    def __init__(self, spark: SparkSession, root: str, batch_id: int | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.batch_id, self.bucket_rows = spark, root, batch_id, bucket_rows
        names = [n for n in child_names(spark, f"{root}/manifest") if n.endswith(".json")]
        before = [n for n in names if batch_id is None or int(n[:-5]) < batch_id]
        self.tables: dict[str, list[dict]] = json.loads(read_text(spark, f"{root}/manifest/{before[-1]}")) if before else {}

    def segments(self, table: str) -> list[dict]:
        return self.tables.get(table, [])

    def folders(self, table: str, keys: DataFrame | None = None, key: str = "") -> list[tuple[str, list[str]]]:
        """Each segment with the folders that hold the keys, all without keys. The driver gets a number a folder at most."""
        found, named = [], {}
        for segment in self.segments(table):
            bits = segment["bits"]
            if keys is not None and bits not in named:
                named[bits] = {r.b for r in keys.select(_bucket(key, bits).alias("b")).distinct().collect()} if bits else {0}
            buckets = segment["buckets"] if keys is None else [b for b in segment["buckets"] if b in named[bits]]
            path = f"{self.root}/{table}/{segment['name']}"
            if buckets:
                found.append((path, [f"{path}/bucket={b}" for b in buckets]))
        return found

    def read(self, table: str, schema: T.StructType, keys: DataFrame | None = None, key: str = "") -> DataFrame:
        """Rows of the table; with ``keys``, of the folders that hold them."""
        whole = None
        for path, folders in self.folders(table, keys, key):
            # A segment that is wanted whole is one path, however many folders it has.
            everything = len(folders) == len(next(s for s in self.segments(table) if path.endswith(s["name"]))["buckets"])
            reader = self.spark.read.schema(schema).option("basePath", path)
            rows = (reader.parquet(path) if everything else reader.parquet(*folders)).select(*schema.fieldNames())
            whole = rows if whole is None else whole.unionByName(rows)
        return self.spark.createDataFrame([], schema) if whole is None else whole

    def _union(self, table: str, segments: list[dict], schema: T.StructType) -> DataFrame:
        """Rows of whole segments; each has partition folders of its own, so each is read for itself."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{s['name']}").select(*schema.fieldNames()) for s in segments]
        return functools.reduce(DataFrame.unionByName, parts)

    def _write(self, table: str, rows: DataFrame, key: str, count: int, level: int) -> dict:
        bits = max(0, math.ceil(math.log2(max(1, count) / self.bucket_rows)))
        name = f"segment-{self.batch_id:0{DIGITS}d}-{uuid.uuid4().hex}"
        dealt = rows.withColumns({"bucket": _bucket(key, bits), "_hash": _hash(key)})
        # Range borders can split a folder that one key fills.
        dealt = dealt.repartitionByRange("bucket", "_hash", F.monotonically_increasing_id()).sortWithinPartitions("bucket", "_hash").drop("_hash")
        path = f"{self.root}/{table}/{name}"
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        buckets = sorted(int(n.split("=")[1]) for n in child_names(self.spark, path) if n.startswith("bucket="))
        return {"name": name, "bits": bits, "buckets": buckets, "rows": count, "level": level}

    def add(self, table: str, rows: DataFrame, key: str) -> None:
        """Add a staged frame as a segment of the table, and merge segments of a size while there are ``FAN`` of them."""
        count = rows.count()
        if not count:
            return
        segments = [*self.segments(table), self._write(table, rows, key, count, 0)]
        level = 0
        while len(same := [s for s in segments if s["level"] == level]) >= FAN:
            one = self._write(table, self._union(table, same, rows.schema), key, sum(s["rows"] for s in same), level + 1)
            segments = [s for s in segments if s["level"] != level] + [one]
            level += 1
        self.tables[table] = segments

    def commit(self) -> None:
        """Name the segments that hold from now on, and delete those that neither this batch nor a replay of it needs."""
        own = f"{self.batch_id:0{DIGITS}d}.json"
        write_text(self.spark, f"{self.root}/manifest/{own}", json.dumps(self.tables))
        names = [n for n in child_names(self.spark, f"{self.root}/manifest") if n.endswith(".json") and n <= own]
        for name in names[:-2]:
            remove(self.spark, f"{self.root}/manifest/{name}")
        live = [json.loads(read_text(self.spark, f"{self.root}/manifest/{name}")) for name in names[-2:]]
        for table in {t for tables in live for t in tables}:
            needed = {s["name"] for tables in live for s in tables.get(table, [])}
            for name in child_names(self.spark, f"{self.root}/{table}"):
                if name.startswith("segment-") and name not in needed:
                    remove(self.spark, f"{self.root}/{table}/{name}")
