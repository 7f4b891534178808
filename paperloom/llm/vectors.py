"""Columns of vectors as matrices of whole numbers, for the operators on ``embeddings``.

A vector counts if it has the table's dimension and none of its entries is null or not finite. The dimension is the length
that most vectors have (of lengths with equally many, the larger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that are worked on at a time.
ROWS = 4096


def dimension(rows: DataFrame, vector: str) -> int:
    """Length of most vectors, 0 without any. One row a length is shuffled, one reaches the driver."""
    sizes = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the vectors that count, their entries as doubles, a row each)."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null entry becomes NaN
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def scaled(x: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * x) as longs, at least -most and at most ``most``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * factor), -most, most).astype(np.int64)


def batches(stream: Iterator[pa.RecordBatch], vector: str, dim: int, factor: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of each batch's vectors that count, at most ROWS at a time: their rows and their scaled entries."""
    for batch in stream:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            at, x = matrix(part.column(vector), dim)
            if len(at):
                yield part.take(pa.array(at)), scaled(x, factor, most)
