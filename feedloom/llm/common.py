"""Column helpers that several operators share. Nulls: a null text is empty, a null id counts as empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

WHITE_SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE_SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text; it splits documents into training and held-out ones."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def number_key(rows: DataFrame, key: str) -> Column:
    """The id as a number: whole numbers as they are, ids of another type by a hash of their text. Null stays null."""
    if isinstance(rows.schema[key].dataType, IntegralType):
        return F.col(key).cast("long")
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def whole_key(rows: DataFrame, key: str) -> Column:
    """The id, whole numbers as long ones."""
    return F.col(key).cast("long") if isinstance(rows.schema[key].dataType, IntegralType) else F.col(key)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts don't add up to a large batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def slices(batch, column: str, most_bytes: int = 4 << 20):
    """Parts of an Arrow batch whose texts together have about ``most_bytes``; a longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // most_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


def output_schema(df: DataFrame, **added: str):
    """Schema of ``df`` with columns added, or replaced where the name is taken."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [f for f in df.schema.fields if f.name not in added]
    return StructType([*kept, *[StructField(name, _parse_datatype_string(kind)) for name, kind in added.items()]])
