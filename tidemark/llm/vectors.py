"""Vectors of embeddings: which take part, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not NULL, not zero, and every component finite."""
    vector = F.col(column)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """The vectors, all of one length, in double precision and of norm 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if rows is not None:
        column = column.take(pa.array(rows))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(1, keepdims=True)  # squares stay in range
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def by_length(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """The rows of each length of vector."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the same for equal rows wherever they stand, as products of matrices aren't to the last bit."""
    return np.minimum((a * b).sum(1), 1.0)
