"""Mixing sources to target weights by Poisson replication.

A source's documents repeat at a mean rate that gives the source its target share. Each document's count is the quantile
of a Poisson distribution of that mean at a hash-seeded uniform number; the document is exploded by its count and the
copies are put in an order by hash, which shuffles them globally: the hash is uniform, so partitions are equal ranges of it
and no pass over the data has to find their bounds. Counts depend on nothing but seed, doc_id and rate, so retried tasks
agree and no state is kept. A rate's table of probabilities leaves out what is beyond twelve standard deviations.

Defined cases: a null source is a source of its own; null and empty texts are mixed like others; rows that share a doc_id
get equal counts, and an order by their texts; a null doc_id is replaced by the text's MD5; sources without a weight get
``default``; a source of weight zero goes; an empty table gives no rows; extra columns stay untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sources that are broadcast at most; more are joined by shuffle, hot ones salted.
BROADCAST_SOURCES = 50_000
#: Entries of their tables that are broadcast at most (32 MB).
BROADCAST_ENTRIES = 4_000_000


def digest_number(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


#: ln k! of the small k, for which Stirling's series is too coarse.
LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(16)]


def log_factorial(k: Column) -> Column:
    series = k * F.ln(k) - k + F.ln(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * F.pow(k, F.lit(5.0)))
    return F.when(k < len(LOG_FACTORIALS), F.get(F.array(*map(F.lit, LOG_FACTORIALS)), k.cast("int"))).otherwise(series)


def poisson_table(rate: Column) -> Column:
    """(low, all): P(K <= k) for k = low, low + 1, ... well into the tail; what lies below low is nothing in doubles."""
    spread = 12 * F.sqrt(rate) + 30
    low = F.greatest(F.floor(rate - spread), F.lit(0)).cast("long")
    terms = lambda bottom: F.transform(F.sequence(bottom, F.ceil(rate + spread).cast("long")), lambda k: F.exp(k * F.ln(rate) - rate - log_factorial(k.cast("double"))))
    sums = common.running(terms(low), F.lit(0.0), lambda total, term: (total + term, F.array(total + term)), F.array().cast("array<double>"))
    return F.when(rate > 0, F.struct(low.alias("low"), sums.alias("all"))).otherwise(F.struct(F.lit(0).cast("long").alias("low"), F.array(F.lit(1.0)).alias("all")))


def rates(documents: DataFrame, weights: dict[str, float] | None, alpha: float, default: float, size: float) -> DataFrame:
    """_pl_source, _n, _rate: mean copies of each document. Without weights, targets are as n ** alpha."""
    counts = documents.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_pl_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(float(default))
        for name, value in weights.items():
            weight = F.when(F.col("_pl_source") == name, F.lit(float(value))).otherwise(weight)
    weighed = counts.withColumn("_weight", weight)
    total, mass = weighed.agg(F.sum("_n"), F.sum("_weight")).first()
    if not total or not mass:
        return weighed.select("_pl_source", "_n", F.lit(0.0).alias("_rate"))
    rate = F.col("_weight") / F.lit(float(mass)) * F.lit(float(total) * size) / F.col("_n")
    return weighed.select("_pl_source", "_n", rate.alias("_rate"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, default: float = 1.0, size: float = 1.0, seed: int = 17) -> DataFrame:
    """Documents with ``_pl_copy`` (from 0) and ``_pl_order``, globally shuffled: partitions and rows are in this order."""
    by_source = rates(documents, weights, alpha, default, size)
    sources = common.written(by_source.withColumn("_pl_table", poisson_table(F.col("_rate"))), "rates")
    many = documents.withColumn("_pl_source", F.coalesce(F.col("source"), F.lit("")))
    rows, entries = sources.agg(F.count("*"), F.coalesce(F.sum(F.size("_pl_table.all")), F.lit(0))).first()
    if rows <= BROADCAST_SOURCES and entries <= BROADCAST_ENTRIES:
        joined = many.join(F.broadcast(sources.select("_pl_source", "_pl_table")), "_pl_source")
    else:
        hot = common.hot_keys(sources, "_pl_source", "_n", documents.count())
        joined = common.join_one(many, sources.select("_pl_source", "_pl_table"), "_pl_source", hot, "doc_id", "inner")
    body = F.md5(F.coalesce(F.col("text"), F.lit("")))
    named = joined.withColumn("_pl_body", body).withColumn("_pl_key", F.coalesce(F.col("doc_id").cast("string"), F.col("_pl_body")))
    u = digest_number(13, F.lit(f"{seed}"), F.col("_pl_key")) / F.lit(float(1 << 52))
    counted = named.withColumn("_pl_u", u).withColumn("_pl_copies", F.expr("_pl_table.low + size(filter(_pl_table.all, c -> c <= _pl_u))"))
    # exploded in two steps, so that no array is as long as a document's copies are many
    parts = counted.where("_pl_copies > 0").withColumn("_pl_part", F.explode(F.expr("sequence(0L, (_pl_copies - 1) div 4096)")))
    copies = parts.withColumn("_pl_copy", F.explode(F.expr("sequence(_pl_part * 4096, least(_pl_copies, _pl_part * 4096 + 4096) - 1)")))
    placed = copies.withColumn("_pl_order", digest_number(15, F.lit(f"{seed}"), F.col("_pl_key"), F.col("_pl_copy").cast("string"), F.col("_pl_body")))
    placed = placed.drop("_pl_source", "_pl_table", "_pl_u", "_pl_copies", "_pl_part", "_pl_key", "_pl_body")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.least(F.floor(F.col("_pl_order") / F.lit(float(1 << 60)) * n).cast("int"), F.lit(n - 1))
    return placed.repartitionById(n, bucket).sortWithinPartitions("_pl_order")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs)
    return mixed.select("doc_id", "source", F.col("_pl_copy").cast("int").alias("copy"), F.col("_pl_order").alias("shuffle_key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE_SQL = """
WITH sources AS (
  SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1
), total AS (
  SELECT sum(n) AS n, sum(n ** 0.5) AS mass FROM sources
), rate AS (
  SELECT s, (sources.n ** 0.5) / mass * total.n / sources.n AS r FROM sources, total
), cdf AS (
  SELECT s, k, sum(exp(k * ln(r) - r - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS p
  FROM (SELECT s, r, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 40) AS BIGINT))) AS k FROM rate)
), docs AS (
  SELECT doc_id, source, text, coalesce(source, '') AS s,
         md5(coalesce(text, '')) AS body, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT doc_id, source, key, body, (SELECT count(*) FROM cdf WHERE cdf.s = docs.s AND p <= u) AS copies FROM docs
)
SELECT doc_id, source, CAST(c AS INTEGER) AS copy,
       CAST('0x' || substr(md5('17:' || key || ':' || c || ':' || body), 1, 15) AS BIGINT) AS shuffle_key,
       body AS text_md5
FROM (SELECT *, unnest(range(0, copies)) AS c FROM counted)
"""
