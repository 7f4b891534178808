"""Substring and ranked search over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Matches that are listed of a document.
MAX_MATCHES = 2000


def match_count(text: Column, needle: str, ignore_case: bool = True) -> Column:
    """Non-overlapping occurrences."""
    x, n = (F.lower(text), needle.lower()) if ignore_case else (text, needle)
    return F.floor((F.length(x) - F.length(F.replace(x, F.lit(n), F.lit("")))) / len(n)).cast("long")


def matches(documents: DataFrame, doc: list[str], needle: str, text: str = "text", ignore_case: bool = True, most: int = MAX_MATCHES) -> DataFrame:
    """doc, k (from 0), offset: places of the first ``most`` occurrences, by the lengths of what lies between them."""
    x = F.lower(F.col(text)) if ignore_case else F.col(text)
    n = needle.lower() if ignore_case else needle
    gaps = documents.where(F.contains(x, F.lit(n))).select(*doc, F.posexplode(F.split(x, r"\Q" + n + r"\E", -1)).alias("k", "_gap"))
    w = Window.partitionBy(*doc).orderBy("k")
    at = F.sum(F.length("_gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * len(n)
    last = F.lead("k").over(w).isNull()
    return gaps.withColumns({"offset": at, "_last": last}).where(~F.col("_last") & (F.col("k") < most)).select(*doc, "k", F.col("offset").cast("long").alias("offset"))


def bm25(documents: DataFrame, doc: str, query: list[str], text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 score of every document that holds a query word (Robertson and Zaragoza, 2009)."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    sized = documents.select(doc, words.alias("_w")).withColumn("_n", F.size("_w"))
    sizes = sized.agg(F.count("*").alias("docs"), F.avg("_n").alias("mean")).first()
    frequency_of = lambda q: F.size(F.filter("_w", lambda x: x == q))
    each = sized.select(doc, "_n", *[frequency_of(q).alias(f"_q{i}") for i, q in enumerate(query)])
    hit = each.where(" OR ".join(f"_q{i} > 0" for i in range(len(query))))
    frequency = hit.agg(*[F.count_if(F.col(f"_q{i}") > 0).alias(f"d{i}") for i in range(len(query))]).first()
    score = F.lit(0.0)
    for i in range(len(query)):
        df = frequency[f"d{i}"] or 0
        idf = F.log(F.lit((sizes["docs"] - df + 0.5) / (df + 0.5) + 1))
        tf = F.col(f"_q{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / (sizes["mean"] or 1.0)))
    return hit.select(doc, score.alias("score"))
