"""Vector code compression: product codes of whole-number vectors by partial-distance search.

Vectors are cut into equal parts; each part position has a codebook, which starts as the parts of the smallest vec_ids and
is improved by rounds of assignment and componentwise means, rounded down. Assignment searches by partial distances:
dimensions are taken in descending variance of the codebook, and masks over all (part, entry) pairs of a batch drop an entry
as soon as its accumulated distance is strictly above the best whole distance that its part has so far. All distances are
whole numbers, so ties are real ones and go to the lower index, and no order of rows or tasks changes a code.

A round is one pass over the vectors: a task adds up its parts by entry, the sums meet by an aggregation, and the driver gets
one row for each component of the codebooks, whatever the table's size.

Defined cases: rows whose vector is null, has null or non-finite entries or another length than most vectors are left out;
a length that the number of parts doesn't divide is filled up with zeros; scaled components beyond 2**27 are taken as 2**27;
with fewer vec_ids than entries the codebooks are as much smaller; rows of one vec_id are all encoded, the least of their
vectors is the one that a codebook starts from; a null vec_id is encoded but starts no codebook, and where all are null there
is no entry: ``code``, ``error`` and ``label_error`` are null; repeated rows get equal codes and count as often as they
occur; null labels are equal to each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import batches, dimension

#: Largest scaled component: a part's squared distance stays a long for up to 64 components a part, and further by far in practice.
MOST = 1 << 27
#: Labels whose sums are broadcast at most; more are joined by shuffle, hot ones salted.
BROADCAST_LABELS = 100_000


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def parts_of(q: np.ndarray, parts: int) -> np.ndarray:
    """[rows, parts, width]; zeros fill up the last part."""
    short = -q.shape[1] % parts
    if short:
        q = np.concatenate([q, np.zeros((len(q), short), np.int64)], axis=1)
    return q.reshape(len(q), parts, q.shape[1] // parts)


def nearest(x: np.ndarray, book: np.ndarray, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of x; ties go to the lower index.

    The first best is the whole distance to the entry nearest in the first dimension. Entries are then tried in blocks; in
    each the pairs that are still alive get one dimension after another, and those strictly above their row's best are dropped.
    """
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    rank = np.argsort(book[:, 0], kind="stable")
    at = np.searchsorted(book[rank, 0], x[:, 0])
    above, below = np.minimum(at, len(book) - 1), np.maximum(at - 1, 0)
    closer = np.abs(book[rank[below], 0] - x[:, 0]) <= np.abs(book[rank[above], 0] - x[:, 0])
    index = np.where(closer, rank[below], rank[above])
    best = ((x - book[index]) ** 2).sum(axis=1)
    for low in range(0, len(book), block):
        far = (x[:, :1] - book[low : low + block, 0]) ** 2
        row, entry = np.nonzero(far <= best[:, None])
        far, entry = far[row, entry], entry + low
        for k in range(1, x.shape[1]):
            far = far + (x[row, k] - book[entry, k]) ** 2
            live = far <= best[row]
            row, entry, far = row[live], entry[live], far[live]
        if not len(row):
            continue
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # pairs lie by row, then by entry
        least = np.minimum.reduceat(far, starts)
        hits = np.flatnonzero(far == np.repeat(least, np.diff(np.append(starts, len(row)))))
        own, first = row[starts], entry[hits[np.unique(row[hits], return_index=True)[1]]]
        better = (least < best[own]) | (least == best[own]) & (first < index[own])
        best[own[better]], index[own[better]] = least[better], first[better]
    return index, best


def assign(cut: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance of each part), both [rows, parts]."""
    found = [nearest(cut[:, k], books[k]) for k in range(len(books))]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def first_books(rows: DataFrame, vector: str, dim: int, settings: Settings) -> np.ndarray:
    """[parts, entries, width]: the parts of the smallest vec_ids. A task hands on as many rows as there are entries."""
    most = settings.entries

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for own, q in batches(stream, vector, dim, settings.scale, MOST):
            ids = own.column("vec_id")
            named = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            ids = ids.take(pa.array(named)).to_numpy(zero_copy_only=False)
            if len(found) >= most:
                few = ids <= max(found)
                named, ids = named[few], ids[few]
            for at, i in zip(named.tolist(), ids.tolist(), strict=True):
                entry = q[at].tolist()
                found[i] = min(found[i], entry) if i in found else entry
                if len(found) > 4 * most:
                    found = dict(sorted(found.items())[:most])
            found = dict(sorted(found.items())[:most])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["vec_id", "entries"])

    some = rows.select("vec_id", vector).mapInArrow(run, "vec_id long, entries array<long>")
    first = some.groupBy("vec_id").agg(F.min("entries").alias("entries")).orderBy("vec_id").limit(most).collect()
    return parts_of(np.array([r["entries"] for r in first], np.int64).reshape(-1, dim), settings.parts).transpose(1, 0, 2)


def improved(rows: DataFrame, books: np.ndarray, vector: str, dim: int, settings: Settings) -> np.ndarray:
    """Each entry replaced by the mean of its parts, rounded down; unused ones stay."""
    parts, entries, width = books.shape

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for _, q in batches(stream, vector, dim, settings.scale, MOST):
            cut = parts_of(q, settings.parts)
            at = (assign(cut, books)[0] + entries * np.arange(parts)).reshape(-1)
            for k in range(width):  # whole numbers below 2**53, so exact as doubles
                sums[:, k] += np.bincount(at, cut[:, :, k].reshape(-1), parts * entries).astype(np.int64)
            sums[:, width] += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(np.repeat(sums[:, width] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.reshape(-1)[used])], ["at", "total"])

    made = rows.select(vector).mapInArrow(run, "at long, total long")
    flat = [0] * (parts * entries * (width + 1))
    for at, total in made.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        flat[at] = int(total)
    new = books.copy()
    for k in range(parts * entries):
        *sums, count = flat[k * (width + 1) : (k + 1) * (width + 1)]
        if count:
            new[k // entries, k % entries] = [s // count for s in sums]
    return new


def fit(rows: DataFrame, vector: str = "embedding", settings: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """Codebooks [parts, entries, width] over all vectors that count (vec_id and ``vector`` of ``rows``)."""
    dim = dimension(rows, vector)
    if not dim:
        return np.zeros((settings.parts, 0, 0), np.int64)
    books = first_books(rows, vector, dim, settings)
    for _ in range(settings.rounds if books.shape[1] else 0):
        books = improved(rows, books, vector, dim, settings)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """vec_id, label, code (an index a part, two hex digits each), error of each vector that counts."""
    dim = dimension(rows, vector)
    kind = rows.schema["label"].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, q in batches(stream, vector, dim, settings.scale, MOST):
            if books.shape[1]:
                entry, far = assign(parts_of(q, settings.parts), books)
                code = pa.array([bytes(x).hex() for x in entry.astype(np.uint8)])
                error = pa.array(far.sum(axis=1))
            else:
                code, error = pa.nulls(len(q), pa.string()), pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), code, error], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", vector).mapInArrow(run, f"vec_id long, label {kind.simpleString()}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """label_error: the error summed over rows of equal label. Few labels are broadcast, else hot ones are salted."""
    keyed = common.written(codes.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    sums = common.written(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        return keyed.join(F.broadcast(sums.drop("_n")), "_key").drop("_key")
    hot = common.hot_keys(sums, "_key", "_n", keyed.count())
    return common.join_one(keyed, sums.drop("_n"), "_key", hot, "code", "inner").drop("_key")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = fit(rows)
    coded = with_label_errors(encode(rows, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * x) AS BIGINT))) AS q,
         generate_subscripts(embedding, 1) - 1 AS pos, CAST(floor(len(embedding) / 16) AS BIGINT) AS width FROM vectors
), parts AS (
  SELECT vec_id, label, CAST(floor(pos / width) AS BIGINT) AS part, list(q ORDER BY pos) AS p FROM cells GROUP BY ALL
), b0 AS (
  SELECT part, e.entry, p AS c FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM vectors ORDER BY vec_id LIMIT 64) e USING (vec_id)
), a0 AS (
  SELECT vec_id, part, any_value(p) AS p, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT vec_id, parts.part, p, entry, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b0 ON parts.part = b0.part) GROUP BY ALL
), m1 AS (
  SELECT part, entry, list(m ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m FROM (
      SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM a0) GROUP BY ALL) GROUP BY ALL
), b1 AS (
  SELECT part, entry, coalesce(m1.c, b0.c) AS c FROM b0 LEFT JOIN m1 USING (part, entry)
), a1 AS (
  SELECT vec_id, part, any_value(p) AS p, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT vec_id, parts.part, p, entry, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b1 ON parts.part = b1.part) GROUP BY ALL
), m2 AS (
  SELECT part, entry, list(m ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m FROM (
      SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM a1) GROUP BY ALL) GROUP BY ALL
), b2 AS (
  SELECT part, entry, coalesce(m2.c, b1.c) AS c FROM b1 LEFT JOIN m2 USING (part, entry)
), a2 AS (
  SELECT vec_id, label, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT vec_id, label, parts.part, entry, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b2 ON parts.part = b2.part) GROUP BY ALL
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded
"""
