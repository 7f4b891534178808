"""How much of an expected text a converted one has, and whether in the same order.

Recall counts character n-grams of both texts, letters and digits alone, as multisets: of an n-gram's occurrences as many are
found as the other text has. Two texts are compared where they meet, in one row; only of documents of several rows are the
n-grams themselves shuffled. Reading order takes the lines that occur once in each text and the longest subsequence of them
that stands in the same order, by a patience fold: the state is the least last place of a subsequence of each length.

Defined cases: a null text counts as empty; a text that is shorter than n has one n-gram, itself; without n-grams the recall
is null, without common lines the order is; only documents of both tables are compared; rows that share their keys are put
together; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import by_row, once
from .grid import before

N = 5


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def grams(documents: DataFrame, keys: list[str], text: str, n: int = N) -> DataFrame:
    """keys, gram, n: each n-gram and how often it occurs; counted where the texts lie before anything is shuffled."""
    sized = documents.select(*keys, plain(F.col(text)).alias("_t")).where("_t <> ''")
    # one pass over the text: substring would begin at its start for each n-gram
    every = F.when(F.length("_t") < n, F.array("_t")).otherwise(F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{{n}}}))."), 1))
    return sized.select(*keys, F.explode(every).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def shared_grams(a: str, b: str, n: int) -> tuple[int, int]:
    """(n-grams of a, how many of them b has), as multisets: an n-gram is a number, exactly, and equal ones are counted."""
    if len(a) < n or len(b) < n:
        return max(len(a) - n + 1, min(len(a), 1)), int(a == b != "")
    codes = np.frombuffer((a + b).encode("utf-32-le"), np.uint32).astype(np.int64)
    base = int(codes.max()) + 1
    numbers, below = codes, base
    for k in range(1, n):
        if below * base >= 1 << 62:
            numbers = np.unique(numbers, return_inverse=True)[1]
            below = int(numbers.max()) + 1
        numbers, below = numbers[:-1] * base + codes[k:], below * base
    (x, n_x), (y, n_y) = (np.unique(side, return_counts=True) for side in (numbers[: len(a) - n + 1], numbers[len(a) :]))
    at = np.searchsorted(x, y)
    met = x[np.minimum(at, len(x) - 1)] == y
    return len(a) - n + 1, int(np.minimum(n_x[at[met]], n_y[met]).sum())


def several(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that rows of a table share; only the keys are read."""
    more = [t.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys) for t in (expected, actual)]
    return more[0].unionByName(more[1]).distinct()


def recall(expected: DataFrame, actual: DataFrame, keys: list[str], text: str = "text", n: int = N) -> DataFrame:
    """keys, grams, found, recall of the expected texts."""
    kind = pa.struct([("grams", pa.int64()), ("found", pa.int64())])

    @F.arrow_udf("grams long, found long")
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        return by_row(lambda x, y: dict(zip(("grams", "found"), shared_grams(x, y, n), strict=True)), kind, a, b)

    def in_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
        left, right = (t.select(*keys, plain(F.col(text)).alias(c)) for t, c in ((expected, "_a"), (actual, "_b")))
        return left.join(right, keys).select(*keys, counted("_a", "_b").alias("_n")).select(*keys, "_n.grams", "_n.found")

    def in_grams(expected: DataFrame, actual: DataFrame) -> DataFrame:
        both = expected.select(*keys).distinct().join(actual.select(*keys).distinct(), keys)
        a, b = grams(expected, keys, text, n), grams(actual, keys, text, n).withColumnRenamed("n", "m")
        sums = a.join(b, [*keys, "gram"], "left").groupBy(*keys).agg(F.sum("n").alias("grams"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("found"))
        return both.join(sums, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("grams", "found")])

    more = several(expected, actual, keys)
    if more.isEmpty():
        out = in_rows(expected, actual)
    else:
        out = in_rows(*[t.join(more, keys, "left_anti") for t in (expected, actual)]).unionByName(in_grams(*[t.join(more, keys, "left_semi") for t in (expected, actual)]))
    return out.withColumn("recall", F.when(F.col("grams") > 0, F.col("found") / F.col("grams")))


def longest_increasing(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an array."""

    def put(tails: Column, x: Column) -> Column:
        return once(before(tails, x), lambda at: F.concat(F.slice(tails, F.lit(1), at), F.array(x), F.slice(tails, at + 2, F.greatest(F.size(tails) - at - 1, F.lit(0)))))

    return F.size(F.aggregate(values.cast("array<int>"), F.array().cast("array<int>"), put))


def reading_order(expected: DataFrame, actual: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, lines, in_order, order: lines that occur once in both texts, and how many of them stand in the same order."""

    def lines(documents: DataFrame, at: str) -> DataFrame:
        each = documents.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias(at, "_l")).select(*keys, at, plain(F.col("_l")).alias("_l")).where("_l <> ''")
        return each.groupBy(*keys, "_l").agg(F.min(at).alias(at), F.count("*").alias("_n")).where("_n = 1").drop("_n")

    both = expected.select(*keys).distinct().join(actual.select(*keys).distinct(), keys)
    met = lines(expected, "_a").join(lines(actual, "_b"), [*keys, "_l"])
    found = met.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_a", "_b"))), lambda x: x["_b"]).alias("_b"))
    counted = found.select(*keys, F.size("_b").alias("lines"), longest_increasing(F.col("_b")).alias("in_order"))
    out = both.join(counted, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "in_order")])
    return out.withColumn("order", F.when(F.col("lines") > 0, F.col("in_order") / F.col("lines")))
