"""Vector functions: native expressions, and numpy over Arrow batches for wide vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.transform(F.array(F.struct(v.alias("v"), F.when(norm == 0, 1.0).otherwise(norm).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def half(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length as stored: normalised in single precision by a norm summed in double, and rounded through half
    precision."""
    m = np.asarray(matrix, np.float32)
    norm = np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    return (m / np.where(norm == 0, 1, norm)).astype(np.float16).astype(np.float32)


def rows_of(column) -> np.ndarray:
    """An Arrow list column as a matrix, without a copy. Lists of unequal lengths are refused."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not n:
        return flat.reshape(0, 0)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal dimensions")
    return flat.reshape(n, -1)


def unit_rows(vectors: DataFrame, dim: int) -> DataFrame:
    """id, embedding as it is stored (half): every vector must have dim dimensions."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            if column.null_count or set(np.diff(column.offsets.to_numpy())) - {dim}:
                raise ValueError(f"an embedding has not {dim} dimensions")
            stored = half(rows_of(column)) if len(column) else np.zeros((0, dim), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stored) + 1) * dim, pa.int32()), pa.array(stored.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "embedding"])

    return vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "id string, embedding array<float>")


def pack(matrix: np.ndarray) -> list[bytes]:
    """Rows as half-precision bytes, little-endian: exact for what half() gave."""
    return [row.tobytes() for row in matrix.astype("<f2")]


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<f2")


def packed_rows(column) -> np.ndarray:
    """An Arrow binary column of equal sizes as a half-precision matrix: a view of the column's buffer, without a copy."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), "<f2")
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int32, n + 1, column.offset * 4)
    sizes = np.diff(ends)
    if column.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal dimensions")
    return np.frombuffer(data, "<f2", int(ends[-1] - ends[0]) // 2, int(ends[0])).reshape(n, -1)
