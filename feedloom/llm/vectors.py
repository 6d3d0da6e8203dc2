"""Helpers for tables of vectors: which take part, distinct ones, and random rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dimension(rows: DataFrame, vector: str) -> int:
    """The most frequent number of components of the vectors, the smaller of equally frequent ones; 0 without any."""
    sizes = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count()
    found = sizes.orderBy(F.desc("count"), "size").first()
    return found["size"] if found else 0


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, one other than zero, and no null or non-finite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """List values of equal length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, with its columns as directions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
