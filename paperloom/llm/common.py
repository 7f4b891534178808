"""Plumbing shared by the training-data operators: shared storage, whole-table inputs, skew-proof joins."""

from __future__ import annotations

import os
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import filesystem, qualified

#: At most this many keys can each hold 1/HOT_KEYS of the rows, which bounds the list of hot keys.
HOT_KEYS = 256
#: A hot key's rows are dealt over this many salts at least, and over more so that a salt has SALT_ROWS at most.
SALTS, SALT_ROWS = 32, 2_000_000
#: Rows with the same first key from which semi_once drops repeats task by task before they meet.
REPEATS = 1000


class Hot(NamedTuple):
    """Keys that many rows share, and the salts over which each is dealt."""

    keys: list
    salts: int


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/paperloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a written table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        store, path = filesystem(folder)
        store.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def let(value: Column, use) -> Column:
    """``use(value)`` where the value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step, out: Column, chunk: int = 256) -> Column:
    """Results of a fold, one array after another: ``step(state, item)`` gives (new state, array to add).

    The array grows by chunks, so that a long one isn't copied for each item. ``out`` is an empty array of the result's type.
    """

    def inner(acc: Column, item: Column) -> Column:
        state, new = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], new).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), out.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")))

    def whole(all_items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(chunk))
        start = F.struct(zero.alias("state"), F.filter(F.array(out), lambda _: F.lit(False)).alias("parts"))
        return F.aggregate(F.transform(starts, lambda at: F.slice(all_items, at, chunk)), start, outer, lambda acc: F.flatten(acc["parts"]))

    return let(items, whole)


def hot_keys(sizes: DataFrame, key: str, count: str, total: int, least: int = 1000) -> Hot:
    """Keys holding at least 1/HOT_KEYS of all rows: never more than HOT_KEYS values, so safe on the driver."""
    least = max(least, total // HOT_KEYS)
    found = [r[0] for r in sizes.where(F.col(count) >= least).select(key).collect()]
    return Hot(found, max(SALTS, total // SALT_ROWS))


def salt_for(key: Column, hot: Hot, spread: Column) -> Column:
    """The salt of a row on the many side: varies over the row for hot keys, else zero."""
    if not hot.keys:
        return F.lit(0)
    return F.when(key.isin(hot.keys), F.pmod(F.xxhash64(spread), F.lit(hot.salts))).otherwise(0).cast("int")


def salts_of(key: Column, hot: Hot) -> Column:
    """All salts under which a row of the one-per-key side has to appear."""
    if not hot.keys:
        return F.array(F.lit(0))
    return F.when(key.isin(hot.keys), F.sequence(F.lit(0), F.lit(hot.salts - 1))).otherwise(F.array(F.lit(0)))


def by_size(n: Column, spread: Column, most: int) -> Column:
    """The salt of a row whose key is known to have n rows, so that a salt has about ``most`` of them."""
    return F.pmod(F.xxhash64(spread), F.ceil(n / most)).cast("int")


def all_by_size(n: Column, most: int) -> Column:
    """All salts of a key with n rows."""
    return F.sequence(F.lit(0), (F.ceil(n / most) - 1).cast("int"))


def join_one(many: DataFrame, one: DataFrame, key: str, hot: Hot, spread: str, how: str = "left") -> DataFrame:
    """Join rows to a table with one row a key. Hot keys are salted on the many side and replicated on the other."""
    left = many.withColumn("_pl_salt", salt_for(F.col(key), hot, F.col(spread)))
    right = one.withColumn("_pl_salt", F.explode(salts_of(F.col(key), hot)))
    return left.join(right, [key, "_pl_salt"], how).drop("_pl_salt")


def default_tokenizer() -> str:
    """Place of the public byte-level BPE vocabulary; any function here takes another path instead."""
    if "PAPERLOOM_TOKENIZER" in os.environ:
        return os.environ["PAPERLOOM_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def semi_once(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are wanted, one row for each distinct keys; the keys go. Both steps share one shuffle.

    A row that is repeated many times doesn't meet itself whole in one task: of rows whose first key many share (HOT_KEYS
    keys at most; counted without the other columns), one a task and keys goes on.
    """
    counts = rows.groupBy(keys[0]).agg(F.count("*").alias("_pl_n"))
    hot = [r[0] for r in counts.where(F.col("_pl_n") >= REPEATS).orderBy(F.desc("_pl_n")).limit(HOT_KEYS).collect()]
    if hot:
        few = rows.where(F.col(keys[0]).isin(hot)).withColumn("_pl_task", F.spark_partition_id()).dropDuplicates([*keys, "_pl_task"])
        rows = rows.where(~F.col(keys[0]).isin(hot)).unionByName(few.drop("_pl_task"))
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys).drop(*keys)
