"""Best-fit packing, planned over a histogram of lengths.

Tokenising gives pieces and their lengths. The driver plans best-fit decreasing over the counts by length (a table of at
most ``size`` rows, whatever the corpus), giving for each length a list of slots: runs of ranks that fill like bins.
Pieces then take their slots by joining on rank within length; ranks come from salted windows and a small table of
prefix sums, so that no length, however common, is numbered by one task.

Defined cases: null and empty texts make one piece of the end id; a text longer than ``size`` tokens is cut into pieces
of ``size``, the first taking the remainder; rows that share a doc_id or a text are packed one by one; ties in length are
ranked by doc_id and piece; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoding import CACHED, encoder, slices

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Windows that number the pieces of one length: this many at least, and more so that one has SALT_ROWS at most.
SALTS, SALT_ROWS = 64, 1_000_000


def pieces(documents: DataFrame, tokenizer: str, end_id: int, size: int, cached: int = CACHED) -> DataFrame:
    """Tokenised and cut: one row a piece. ``cached`` bounds what a worker keeps of the tokenizer's results."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, end_id, cached)
        for batch in batches:
            for some in slices(batch, most=ids.slice):
                yield cut_pieces(some.column("doc_id"), *ids.encode(some.column("text")), size)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def cut_pieces(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, size: int) -> pa.RecordBatch:
    """PIECES of documents whose ids lie one after another, each of at least one id."""
    per = -(-counts // size)
    first = counts - (per - 1) * size
    doc = np.repeat(np.arange(len(counts)), per)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.where(piece > 0, first[doc] + (piece - 1) * size, 0)
    length = np.where(piece > 0, size, first[doc])
    begin = (np.cumsum(counts) - counts)[doc] + start
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Slots (length, first rank, ranks, first sequence, pieces in each sequence, offset).

    Bins that are filled alike form one group (room left, first sequence, bins, used); a length consumes whole groups,
    tightest first, or splits one, so groups and slots stay in the order of the number of lengths.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, bins)]
    rooms: list[int] = []
    slots, sequences = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if room > 0 and bins > 0:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            heapq.heappush(groups[room], (first, bins))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                per = min(size // length, left)
                bins = left // per
                slots.append((length, rank, bins * per, sequences, per, 0))
                put(size - per * length, sequences, bins)
                sequences, rank, left = sequences + bins, rank + bins * per, left - bins * per
                continue
            room = rooms[k]
            first, bins = heapq.heappop(groups[room])
            per = min(room // length, left)
            use = min(bins, left // per)
            slots.append((length, rank, use * per, first, per, size - room))
            if not groups[room]:
                del groups[room], rooms[k]
            put(room, first + use, bins - use)
            put(room - per * length, first, use)
            rank, left = rank + use * per, left - use * per
    return slots


def pack(cut: DataFrame, size: int) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut`` has to be a stored table: it's read twice."""
    spark, salts = cut.sparkSession, max(SALTS, cut.count() // SALT_ROWS)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # counts by length and salt, joined where the windows are dealt already; counts by length, size rows on the driver
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r["length"]: r["_n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    slots = plan(counts, size)
    table = pd.DataFrame(slots, columns=["length", "_first", "_ranks", "_sequence", "_per", "_offset"])
    slot_rows = spark.createDataFrame(table.astype("int64"), "length long, _first long, _ranks long, _sequence long, _per long, _offset long") if slots else spark.createDataFrame([], "length long, _first long, _ranks long, _sequence long, _per long, _offset long")
    by_length = slot_rows.groupBy(F.col("length").cast("int").alias("length")).agg(F.array_sort(F.collect_list(F.struct("_first", "_sequence", "_per", "_offset"))).alias("_slots"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_local", F.row_number().over(within) - 1).join(bases.hint("merge"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_local") + F.col("_base"))
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("_slot", last_at_most("_slots", "_rank"))
    inside = F.col("_rank") - F.col("_slot._first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("_slot._sequence") + F.floor(inside / F.col("_slot._per"))).cast("long").alias("sequence_id"),
        (F.col("_slot._offset") + F.pmod(inside, F.col("_slot._per")) * F.col("length")).cast("long").alias("offset"),
    )


def last_at_most(slots: str, rank: str):
    """The last slot whose first rank isn't above the rank."""
    return F.expr(f"element_at(filter({slots}, s -> s._first <= {rank}), -1)")


def best_fit(documents: DataFrame, tokenizer: str | None = None, end_id: int = 0, size: int = 2048, cached: int = CACHED) -> DataFrame:
    cut = common.written(pieces(documents, tokenizer or common.default_tokenizer(), end_id, size, cached), "pieces")
    return pack(cut, size)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.documents(spark, sf_dir))
