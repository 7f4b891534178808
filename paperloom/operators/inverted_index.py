"""A stored inverted index and exact top-k search that skips blocks.

Documents of a task are put in an order by their length and cut into ranges of a few of them. A block holds a word's postings
in one range: documents, by their place in it, with how often they hold the word. Blocks of all words share these ranges, so a
range's score is bounded by the sum of its blocks' greatest impacts (the part of BM25 that doesn't hang on the word's rarity). A
search reads the bounds alone (columns beside the postings), then the postings of the ranges with the highest bounds, whose k-th
best score is a threshold, and at last those of the ranges whose bound reaches it. What lies in the other ranges can't be among
the k best.

The index is made where the texts are: neither texts, words nor postings are shuffled, and a task lays out a range at a time. A
search shuffles blocks of its own words only, by range.

Queries are searched in batches: everything is keyed by the query, and only as many rows a query as ranges hold its words
are compared. A block has no more postings than a range has documents, so a frequent word is many blocks and no large one.

Defined cases: null texts count as documents without words; words of a query count once, in its order, and those that no
document holds are ignored; documents that hold none of a query's words are no results; ties go to the smaller ``doc``; rows
that share ``doc`` are documents of their own; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents of a range.
RANGE = 128
K1, B = 1.2, 0.75
#: Words of queries, and ranges that are read first, that are broadcast at most (some 10 MB); more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Queries whose scores in a range are one matrix of a task.
AT_A_TIME = 1024
BLOCKS = {"word": "string", "range": "long", "n": "long", "top": "double", "slots": "array<int>", "counts": "array<int>"}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def impacts(counts: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / mean))


@dataclass(frozen=True)
class SearchIndex:
    """Tables below ``path``: documents (at, doc, words, length), blocks (word, range, n, top, slots, counts), words (word, documents)."""

    spark: SparkSession
    path: str
    docs: int
    mean: float = 1.0
    size: int = RANGE

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def known(self, queries: DataFrame) -> DataFrame:
        """query, k, word, weight: words of the queries that documents hold."""
        asked = queries.select("query", F.posexplode(F.array_distinct("words")).alias("k", "word"))
        few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        hinted = F.broadcast if few else lambda x: x
        weight = F.log((self.docs - F.col("documents") + 0.5) / (F.col("documents") + 0.5) + 1)
        return hinted(self.table("words").join(hinted(asked), "word").select("query", "k", "word", weight.alias("weight")))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query, k, word, weight, range, n, top: the heads of the blocks that hold words of the queries."""
        return self.heads(self.known(queries))

    def heads(self, known: DataFrame, *more: str) -> DataFrame:
        return self.table("blocks").select("word", "range", "n", "top", *more).join(known, "word")

    def ranges(self, queries: DataFrame) -> DataFrame:
        """query, range, bound, blocks: no document of the range scores above the bound."""
        return self.bounded(self.known(queries))

    def bounded(self, known: DataFrame) -> DataFrame:
        """Ranges of words that are known.

        The bound is added up in the queries' order of words, as scores are, and the greatest impacts are no less than any,
        so rounding can't put a score above it.
        """
        heads = self.heads(known).groupBy("query", "range").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("weight") * F.col("top")).alias("x")))).alias("_x"))
        return heads.select("query", "range", total(F.col("_x")).alias("bound"), F.size("_x").alias("blocks"))

    def scores(self, known: DataFrame, ranges: DataFrame, k: int, lots: int, few: bool = False) -> DataFrame:
        """query, doc, at, score of each range's k best documents, and those level with the last, in these ranges (query, range).

        Blocks of the queries' words meet by their range, a lot of the queries at a time. Few ranges are broadcast, so that
        blocks of others aren't shuffled.
        """
        lot = F.expr(f"pmod(hash(query), {lots})")
        wanted = ranges.select("query", "range", lot.alias("lot"))
        blocks = self.heads(known, "slots", "counts").select("query", "k", "weight", "range", lot.alias("lot"), "slots", "counts")
        if few:
            blocks = blocks.join(F.broadcast(wanted), ["query", "range", "lot"], "left_semi")
        documents = self.table("documents").select("at", "doc", "length")
        members = documents.groupBy(F.expr(f"at div {self.size}").alias("range")).agg(F.collect_list(F.struct("at", "doc", "length")).alias("members"))
        asked = wanted.groupBy("range", "lot").agg(F.collect_list("query").alias("queries")).join(members, "range")
        kinds = dict(known.dtypes) | dict(documents.dtypes)
        made = blocks.groupBy("range", "lot").cogroup(asked.groupBy("range", "lot"))
        return made.applyInArrow(scorer(k, self.size, self.mean), f"query {kinds['query']}, doc {kinds['doc']}, at long, score double")

    def top(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query, place (from 1), doc, score: the k best documents of each query (query, words), exactly."""
        known, n = self.known(queries), queries.count()
        return best(self.scores(known, self.planned(known, n, k), k, n // AT_A_TIME + 1), k).select("query", "place", "doc", "score")

    def plan(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query, range, bound, blocks of the ranges whose postings a search for the k best has to read."""
        return self.planned(self.known(queries), queries.count(), k)

    def planned(self, known: DataFrame, n: int, k: int) -> DataFrame:
        ranges = self.bounded(known)
        by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "range")
        first = ranges.withColumn("_r", F.row_number().over(by_bound)).where(F.col("_r") <= k)
        # each range has a document at least: the k-th best of k ranges is below none of the k best of all
        threshold = best(self.scores(known, first, k, n // AT_A_TIME + 1, n * k <= BROADCAST_ROWS), k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        return ranges.join(threshold, "query").where((F.col("found") < k) | (F.col("bound") >= F.col("least"))).drop("least", "found")


def total(parts: Column) -> Column:
    """Sum of the x of sorted structs, in their order."""
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["x"])


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc", "at")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def scorer(k: int, size: int, mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores in a range from its blocks (query, k, weight, slots, counts), and one row of its documents and of the queries to score."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        members = asked["members"].combine_chunks().flatten()
        queries = asked["queries"].combine_chunks().flatten()
        at, doc = members.field("at").to_numpy(), members.field("doc")
        if not blocks.num_rows or not len(queries):
            return pa.table({"query": queries.take(none), "doc": doc.take(none), "at": none, "score": np.zeros(0)})
        blocks = blocks.append_column("row", pc.index_in(blocks["query"], value_set=queries))
        blocks = blocks.filter(pc.is_valid(blocks["row"])).combine_chunks()
        slots, counts = (pc.list_flatten(blocks[x]).to_numpy() for x in ("slots", "counts"))
        each = lambda x: np.repeat(blocks[x].to_numpy(), pc.list_value_length(blocks["slots"]).to_numpy())
        member, length = np.zeros(size, np.int64), np.zeros(size)
        member[at % size], length[at % size] = np.arange(len(at)), members.field("length").to_numpy()
        x = each("weight") * impacts(counts.astype(np.float64), length[slots], mean)
        place, order = each("row").astype(np.int64) * size + slots, each("k")
        scores, hit = np.zeros(len(queries) * size), np.zeros(len(queries) * size, bool)
        for rank in np.unique(order):  # a query's words one after the other, as its bound is added up
            now = order == rank
            scores[place[now]] += x[now]
        hit[place] = True
        by_query = np.where(hit, scores, -np.inf).reshape(len(queries), size)
        least = np.partition(by_query, size - k, axis=1)[:, size - k, None] if k < size else -np.inf
        row, slot = np.nonzero(hit.reshape(by_query.shape) & (by_query >= least))
        return pa.table({"query": queries.take(row), "doc": doc.take(member[slot]), "at": at[member[slot]], "score": by_query[row, slot]})

    return run


def blocks_of(documents: pa.Table, size: int, mean: float) -> pa.RecordBatch:
    """Blocks of the documents of one range, by word."""
    at, lengths = documents["at"].to_numpy(), documents["length"].to_numpy()
    words = pc.list_flatten(pc.split_pattern(documents["words"].combine_chunks(), " ")).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank, length = np.zeros(len(order), np.int64), np.zeros(size)
    rank[order], length[at % size] = np.arange(len(order)), lengths
    keys, counts = np.unique(rank[words.indices.to_numpy()] * size + np.repeat(at % size, lengths), return_counts=True)
    word, slots = np.divmod(keys, size)
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    top = np.maximum.reduceat(impacts(counts.astype(np.float64), length[slots], mean), begins)
    ends = np.append(begins, len(word)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in (slots, counts)]
    return pa.RecordBatch.from_arrays([words.dictionary.take(order), pa.array(np.full(len(begins), at[0] // size)), pa.array(np.diff(ends).astype(np.int64)), pa.array(top), *lists], list(BLOCKS))


def layout(size: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents (at, words, length), in their order, to blocks, a range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest else now
            cuts = np.flatnonzero(np.diff(now["at"].to_numpy() // size)) + 1
            begins = [0, *cuts]
            for begin, end in zip(begins, cuts, strict=False):
                yield blocks_of(now.slice(begin, end - begin), size, mean)
            rest = now.slice(begins[-1])
        if rest:
            yield blocks_of(rest, size, mean)

    return run


def build(documents: DataFrame, doc: str, path: str, text: str = "text", size: int = RANGE) -> SearchIndex:
    """Write the index of a table's texts below ``path``, a new place that all executors reach.

    ``at`` numbers documents, a task's in the order of their lengths: it is written first, so that tasks that are run again
    agree. A table with fewer tasks than half the cores is dealt out before.
    """
    spark = documents.sparkSession
    rows, cores = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")), spark.sparkContext.defaultParallelism
    rows = rows.repartition(cores, "doc", "text") if rows.rdd.getNumPartitions() < cores // 2 else rows
    sized = rows.select("doc", words_of(F.col("text")).alias("_w")).select("doc", F.array_join("_w", " ").alias("words"), F.size("_w").alias("length"))
    ordered = sized.sortWithinPartitions("length", "doc", "words")
    # partitions begin at multiples of 2**33, so a range never spans two
    ordered.withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/documents")
    written = spark.read.parquet(f"{path}/documents")
    docs, mean = written.agg(F.count("*"), F.avg("length")).first()
    # a range that is read by two tasks gives two blocks of a word: bounds and scores add up both
    blocks = written.where("length > 0").select("at", "words", "length").mapInArrow(layout(size, mean or 1.0), ", ".join(f"{n} {kind}" for n, kind in BLOCKS.items()))
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("word").agg(F.sum("n").alias("documents"), F.count("*").alias("blocks")).write.option("compression", "zstd").parquet(f"{path}/words")
    return SearchIndex(spark, path, docs, mean or 1.0, size)
