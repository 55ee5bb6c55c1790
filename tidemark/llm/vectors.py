"""Vectors as whole numbers: rows that can be used, and Arrow columns to and from NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to here sums of products of whole numbers are exact in doubles.
EXACT = 2.0**53


def finite_rows(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null and has neither null nor non-finite components."""
    return df.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def floors(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * component) of each list (row, component), int64; all lists have one length and whole finite components."""
    n = len(column)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= EXACT / 2:
        raise ValueError(f"a component times {scale} has no exact whole number")
    return x.astype(np.int64).reshape(n, -1 if n else 0)


def binary_rows(x: np.ndarray) -> pa.Array:
    """A binary value for each row of x."""
    x = np.ascontiguousarray(x)
    width = int(np.prod(x.shape[1:])) * x.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x.tobytes())])


def matrix(column: pa.Array, dtype: str = "<i8") -> np.ndarray:
    """The rows that binary_rows wrote (row, component)."""
    return np.stack([np.frombuffer(b.as_buffer(), dtype) for b in column]) if len(column) else np.zeros((0, 0), dtype)
