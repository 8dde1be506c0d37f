"""Vectors of whole numbers, for operators whose results are exact."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_told

#: Whole numbers up to which double precision is exact.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers; never null."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


def whole_vectors(vectors: DataFrame, scale: int) -> tuple[DataFrame, int, int, int]:
    """(rid, vec_id, label, whole) of the usable rows, their number, their length, and the largest component.

    Components become floor(scale * x). rid tells rows apart, also those that
    repeat, and is fixed as the rows are written. All usable vectors must be of
    one length, and squared distances and products must fit 64 bits: else ValueError.
    """
    numbers = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.where(finite(F.col("embedding"))).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), numbers.alias("whole"))
    largest = F.array_max(F.transform("whole", F.abs))
    kept, told = cut_told(rows, n=F.count(F.lit(1)), least=F.min(F.size("whole")), dim=F.max(F.size("whole")), most=F.max(largest))
    n, dim, most = told["n"], told["dim"] or 0, told["most"] or 0
    if n and told["least"] != dim:
        raise ValueError(f"vectors of different lengths: {told['least']} to {dim}")
    if most > isqrt((2**63 - 1) // max(1, dim)) // 2:
        raise ValueError(f"components up to {most} times 1/{scale}: results would not fit 64 bits")
    return kept, n, dim, most


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of arrays as rows of 64-bit whole numbers."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.int64).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def narrowest(most: int) -> str:
    """The kind of whole number that components up to `most` travel as."""
    return next(f"<i{n}" for n in (2, 4, 8) if most < 1 << (8 * n - 1))


def unpacked(data: bytes, dim: int, rows: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, dim)


def product(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """a @ b.T, exact: in double precision where no sum of components up to `most` can pass 2**53, else in 64-bit whole numbers."""
    if a.shape[1] * most * most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
