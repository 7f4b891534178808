"""Embedding whitening by a digit-slice GEMM.

Entries become whole numbers. A task splits them into limbs of 16 bits, so that float64 products of BLAS over a block of
rows are sums of whole numbers below 2**53 and exact. The products of each pair of limbs are recombined as big integers,
which gives the exact sums of x_i * x_j; a leading 1 in each vector makes the number of rows and the sums of x part of
the same matrix. Tasks hand on digits of 32 bits, whose sums by matrix entry are a plain aggregation; the driver reads one
row an entry, as many as the dimension asks for. The covariance is then an exact fraction, rounded once, and decomposed.

Nothing of this is sampled, and no order of rows or tasks changes a bit of it.

Defined cases: rows whose vector is null, has null or non-finite entries or another length than most vectors are left out
and don't count; a null vec_id is kept as null; repeated rows count and are returned as often as they occur; scaled entries
beyond 2**40 are taken as 2**40; components without variance (up to rounding) are returned with a null ``whitened`` and
don't count in ``identity_error``; without any variance ``explained`` is 0.0; a ``deviation`` that no long holds is null;
components of equal variance are some basis of their space, the same for all rows; an empty table, or one without vectors
that count, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import batches, dimension

LIMB = 16
#: Rows of a task after which its sums of products, kept as longs, are recombined: each is below 2**32 times as many.
RECOMBINE = 1 << 30
#: Largest scaled entry; with it a limb is below 2**16 in size and three limbs hold an entry.
MOST = 1 << 40
DIGIT, DIGITS = 32, 4
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum of ``limb * 2**(16 * k)`` is x: all but the last are from 0 to 65535, the last has the sign."""
    out, rest = [], x
    while True:
        low = rest & ((1 << LIMB) - 1)
        if np.array_equal(low, rest) or (np.abs(rest) < 1 << LIMB - 1).all():
            return [*out, rest.astype(np.float64)]
        out.append(low.astype(np.float64))
        rest = rest >> LIMB


class Moments:
    """Exact sums of x_i * x_j over the rows of a task. Blocks have up to 2**20 rows, so that a product stays below 2**53."""

    def __init__(self, dim: int):
        self.dim, self.rows, self.total = dim, 0, np.zeros((dim, dim), object)
        self.pairs: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray) -> None:
        parts = limbs(x)
        side = np.concatenate(parts, axis=1)
        product = (side.T @ side).astype(np.int64).reshape(len(parts), self.dim, len(parts), self.dim)
        for a in range(len(parts)):
            for b in range(len(parts)):
                kept = self.pairs.setdefault(a + b, np.zeros((self.dim, self.dim), np.int64))
                kept += product[a, :, b]
        self.rows += len(x)
        if self.rows >= RECOMBINE:
            self.recombine()

    def recombine(self) -> np.ndarray:
        for power, sums in self.pairs.items():
            self.total = self.total + (sums.astype(object) << LIMB * power)
        self.pairs, self.rows = {}, 0
        return self.total


def digits(value: int) -> list[int]:
    """Of 32 bits each from the lowest, the last with the sign."""
    return [value >> DIGIT * k & (1 << DIGIT) - 1 for k in range(DIGITS - 1)] + [value >> DIGIT * (DIGITS - 1)]


def augmented(x: np.ndarray, offset: int) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1), np.int64), x + offset], axis=1)


def second_moments(rows: DataFrame, vector: str, dim: int, scale: int, offset: int) -> np.ndarray:
    """Exact sums over all rows of the products of (1, x)'s entries, as a matrix of big integers."""
    upper = [(i, j) for i in range(dim + 1) for j in range(i, dim + 1)]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = Moments(dim + 1)
        for _, x in batches(stream, vector, dim, scale, MOST):
            moments.add(augmented(x, offset))
        found = moments.recombine()
        if found[0, 0]:
            own = np.array([[i, j, *digits(found[i, j])] for i, j in upper], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0], pa.int32()), pa.array(own[:, 1], pa.int32()), *map(pa.array, own[:, 2:].T.copy())], ["i", "j", *names])

    names = [f"d{k}" for k in range(DIGITS)]
    made = rows.select(vector).mapInArrow(run, f"i int, j int, {', '.join(f'{x} long' for x in names)}")
    out = np.zeros((dim + 1, dim + 1), object)
    for i, j, *parts in made.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in names]).collect():
        out[i, j] = out[j, i] = sum(int(p) << DIGIT * k for k, p in enumerate(parts))
    return out


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S; ``project`` [dim, components] takes x - S / n to whitened values, 0 where there is no variance."""

    dim: int
    scale: int
    offset: int
    n: int
    sums: list[int]
    project: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x less the mean's whole part, the rest of the sums over n, x - S / n): only the last is rounded, once."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        y = x - np.array(whole, np.int64)
        return y, np.array(rest, object), y - np.array([r / self.n for r in rest])

    def deviation(self, y: np.ndarray, rest: np.ndarray) -> pa.Array:
        """Sums of (n * x - S)**2: as longs where no step can leave them, else as big integers; null where the sum does."""
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * self.dim < 1 << 63:
            return pa.array(((self.n * y - rest.astype(np.int64)) ** 2).sum(axis=1))
        about = ((float(self.n) * y - rest.astype(np.float64)) ** 2).sum(axis=1)
        exact = [int(((self.n * row.astype(object) - rest) ** 2).sum()) if a < 1e19 else None for row, a in zip(y, about, strict=True)]
        return pa.array([v if v is not None and v < 1 << 63 else None for v in exact], pa.int64())


def decompose(moments: np.ndarray, scale: int, offset: int, components: int) -> Whitening:
    """The covariance (n * M - S * S') / n**2 as exact fractions, each rounded once, and its leading eigenvectors."""
    n, sums, dim = int(moments[0, 0]), [int(s) for s in moments[0, 1:]], len(moments) - 1
    exact = n * moments[1:, 1:] - np.outer(np.array(sums, object), np.array(sums, object))
    cov = np.array([[v / (n * n) for v in row] for row in exact])  # of whole numbers: the nearest double
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)  # one of the two signs
    trace = fsum(np.diag(cov))
    varies = values > dim * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    scaled = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    return Whitening(dim, scale, offset, n, sums, scaled, varies, np.where(values > 0, values, 0.0) / trace if trace > 0 else np.zeros(len(values)))


def fit(rows: DataFrame, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 32) -> Whitening | None:
    """Over all vectors that count; None without any."""
    dim = dimension(rows, vector)
    moments = second_moments(rows, vector, dim, scale, offset) if dim else None
    return decompose(moments, scale, offset, components) if moments is not None and moments[0, 0] else None


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest entry, in size, of the whitened values' covariance less the identity, over the components with variance.

    Values are centred by the exact mean before they are multiplied; what rounding leaves of their mean is taken off after.
    """
    live = np.flatnonzero(model.variance)
    count = len(live) + 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        for _, x in batches(stream, vector, model.dim, model.scale, MOST):
            z = model.centred(x + model.offset)[2] @ model.project[:, live]
            side = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            total += side.T @ side
        if total[0, 0]:
            i, j = np.triu_indices(count)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    if not len(live):
        return 0.0
    sums = rows.select(vector).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = np.zeros((count, count))
    for i, j, value in sums.collect():
        found[i, j] = found[j, i] = value / model.n
    return float(np.abs(found[1:, 1:] - np.outer(found[0, 1:], found[0, 1:]) - np.eye(len(live))).max())


def whiten(rows: DataFrame, model: Whitening, error: float, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """RESULT columns: a row for each vector that counts and each component, numbered from 1."""
    parts = len(model.explained)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, x in batches(stream, vector, model.dim, model.scale, MOST):
            y, rest, u = model.centred(x + model.offset)
            m = len(y) * parts
            z = (u @ model.project).reshape(-1)
            each = pa.array(np.repeat(np.arange(len(y)), parts))
            none = np.tile(~model.variance, len(y))
            columns = [
                own.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(y))),
                pa.array(np.full(m, model.n)),
                model.deviation(y, rest).take(each),
                pa.array(z, mask=none),
                pa.array(np.tile(model.explained, len(y))),
                pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), vector).mapInArrow(run, RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], RESULT)
    return whiten(rows, model, identity_error(rows, model))
