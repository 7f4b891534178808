"""Exact deduplication with a log-structured merge index.

Each task fills a memtable (digest -> identifier to keep, rows) and flushes it as a sorted run when full. Compaction merges
runs by digest, keeping the smallest (or largest) identifier and the sum of rows. A run has each digest once, so a text that
a third of the rows share arrives at compaction as one row a run. The merged run has a Bloom filter of the digests it holds
more than once, of bounded size: rows whose digest the filter rules out are no hits, and their texts never move. The others
are looked up, and the bytes of hits are verified: the least and the greatest text of a digest have to be equal. Where they
aren't, the rows of that digest are grouped by text. With more repeated digests than the filter was made for, more texts
that are no hits are looked up; results stay the same.

Defined cases: null text counts as empty; empty texts are equal to each other; of rows that share text and doc_id one is
kept; a null doc_id is kept only if its text has no other; texts of any length are hashed whole; an empty table gives no
rows; extra columns are ignored (``keep_first`` returns them untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RUN = "digest binary, keep_id long, keep_row long, n long"


def text_sha(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class MergeIndex:
    """Sorted digest runs under one folder. ``keep``: "min" or "max" of the identifiers stays."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "min", memtable: int = 200_000):
        self.spark, self.path, self.keep, self.memtable, self.levels = spark, path, keep, memtable, 0
        self.runs: list[str] = []

    def flush(self, rows: DataFrame) -> None:
        """Add rows (digest, doc_id, row): each task writes the sorted runs of its memtables."""
        most, sign = self.memtable, 1 if self.keep == "min" else -1

        def drain(table: dict) -> pd.DataFrame:
            entries = sorted(table.items())
            made = pd.DataFrame([(d, *e) for d, e in entries], columns=["digest", "keep_id", "keep_row", "n"])
            return made.astype({"keep_id": "Int64", "keep_row": "int64", "n": "int64"})

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table: dict[bytes, tuple] = {}
            for batch in batches:
                ids = batch["doc_id"].astype("Int64")
                for digest, doc_id, row in zip(batch["digest"], ids, batch["row"], strict=True):
                    key = bytes(digest)
                    own = None if doc_id is pd.NA else int(doc_id)
                    old = table.get(key)
                    if old is None:
                        table[key] = (own, row, 1)
                    else:
                        a = (old[0] is None, sign * (old[0] or 0), old[1])
                        b = (own is None, sign * (own or 0), row)
                        table[key] = (old[0], old[1], old[2] + 1) if a <= b else (own, row, old[2] + 1)
                    if len(table) >= most:
                        yield drain(table)
                        table = {}
            if table:
                yield drain(table)

        self.write(rows.select("digest", F.col("doc_id").cast("long"), "row").mapInPandas(fill, RUN))

    def write(self, runs: DataFrame) -> None:
        path = f"{self.path}/run-{self.levels:06d}"
        self.levels += 1
        runs.write.option("compression", "zstd").parquet(path)
        self.runs.append(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*self.runs)

    def compact(self) -> DataFrame:
        """Merge all runs into one sorted run with each digest once."""
        best = (F.min if self.keep == "min" else F.max)("keep_id")
        # a digest's entries (one a run at most) meet in one partition; both steps share that partitioning
        by_id = self.read().repartition("digest").groupBy("digest", "keep_id").agg(F.min("keep_row").alias("keep_row"), F.sum("n").alias("n"))
        order = F.coalesce(F.col("keep_id"), F.lit(-(1 << 62) if self.keep == "max" else (1 << 62)))
        pick = (F.min_by if self.keep == "min" else F.max_by)("keep_row", order)
        merged = by_id.groupBy("digest").agg(best.alias("keep_id"), pick.alias("keep_row"), F.sum("n").alias("n"))
        old = len(self.runs)
        self.write(merged.sortWithinPartitions("digest").select("digest", "keep_id", "keep_row", "n"))
        self.runs = self.runs[old:]
        return self.read()


#: Bits of a filter at most (8 MB), words of 64 bits; and how many hashes set a bit for each digest.
FILTER_BITS, HASHES = 1 << 26, 4


class Filter:
    """A Bloom filter of digests, built where they lie; the driver gets its words, FILTER_BITS / 64 at most."""

    def __init__(self, digests: DataFrame, expected: int, most_bits: int = FILTER_BITS):
        self.bits = min(most_bits, max(1 << 12, 1 << (12 * max(expected, 1)).bit_length()))
        places = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "digest"), F.lit(self.bits)) for k in range(HASHES)]))
        words = digests.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        made = words.toArrow()
        array = np.zeros(self.bits // 64, np.int64)
        array[made.column("word").to_numpy()] = made.column("bits").to_numpy()
        self.shared = digests.sparkSession.sparkContext.broadcast(array.view(np.uint64))

    def maybe(self, digest: str) -> Column:
        """False only for digests that were not put in."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def look(*places: pd.Series) -> pd.Series:
            found = np.ones(len(places[0]), bool)
            for at in places:
                x = at.to_numpy(np.int64).view(np.uint64)
                found &= (shared.value[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pd.Series(found)

        return look(*[F.pmod(F.xxhash64(F.lit(k), F.col(digest)), F.lit(self.bits)) for k in range(HASHES)])


def classify(documents: DataFrame, keep: str = "min", digest_bytes: int = 32, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, sha (binary). ``digest_bytes`` under 32 makes collisions."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hashed = docs.withColumn("sha", text_sha()).withColumn("digest", F.substring("sha", 1, digest_bytes))
    narrow = common.written(hashed.select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    index = MergeIndex(spark, common.fresh_path(spark, "lsm"), keep)
    index.flush(narrow)
    merged = index.compact()
    groups = merged.where("n > 1")
    hot = common.hot_keys(groups, "digest", "n", narrow.count())
    repeated = Filter(groups, groups.count(), filter_bits)
    bad = mismatches(hashed.where(repeated.maybe("digest")), groups, hot)
    found = common.join_one(narrow, groups, "digest", hot, "row")
    alone = F.col("n").isNull()
    result = found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha",
        "digest",
    )
    if not bad.isEmpty():
        exact = by_text(hashed.join(bad, "digest", "left_semi"), keep)
        result = result.join(bad, "digest", "left_anti").select(*exact.columns).unionByName(exact)
    return result.select("doc_id", "keep_id", "group_size", "kept", "sha")


def mismatches(hashed: DataFrame, groups: DataFrame, hot: common.Hot) -> DataFrame:
    """Digests whose rows hold different bytes. Texts move once; a hot digest's rows are compared in salted shares."""
    left = hashed.select("digest", "text").withColumn("_salt", common.salt_for(F.col("digest"), hot, F.monotonically_increasing_id()))
    right = groups.select("digest").withColumn("_salt", F.explode(common.salts_of(F.col("digest"), hot)))
    shares = left.join(right, ["digest", "_salt"], "left_semi").groupBy("digest", "_salt").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    ends = common.written(shares.groupBy("digest").agg((F.min("a") != F.max("b")).alias("differ")).where("differ"), "mismatches")
    return ends.select("digest")


def by_text(rows: DataFrame, keep: str) -> DataFrame:
    """The exact way for colliding digests: groups of equal text."""
    order = F.asc_nulls_last("doc_id") if keep == "min" else F.desc_nulls_last("doc_id")
    group = Window.partitionBy("digest", "sha", "text")
    return rows.select(
        "doc_id",
        (F.min if keep == "min" else F.max)("doc_id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(order)) == 1).alias("kept"),
        "sha",
    )


def keep_first(documents: DataFrame, keep: str = "min") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = classify(documents, keep).where("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_pl_id"), F.col("sha").alias("_pl_sha"))
    return common.semi_once(documents.withColumns({"_pl_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_pl_sha": text_sha()}), kept, ["_pl_id", "_pl_sha"])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(common.documents(spark, sf_dir), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
