"""Embedding columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector is finite and not zero, of any dimension.

    v keeps single precision where the table has it, which halves what is shuffled; all arithmetic is in double.
    """
    v = F.col("v")
    kind = vectors.schema[vector].dataType.simpleString()
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)))


def by_dimension(rows: DataFrame) -> list[DataFrame]:
    """*rows* (id, v) parted by the dimension of v, which only the like can be compared in; one empty part without rows."""
    sizes = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # one number a dimension
    return [rows.where(F.size("v") == n) for n in sizes] or [rows]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that no square overflows or vanishes."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
