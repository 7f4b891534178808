"""Free names for a batch of results: no two targets are equal, and none is taken.

A request's own path goes to the first that asks for it, if it's free. Under the policy "rename" the others get the smallest
free numbers, "name (1).md" and up: taken numbers of a name form runs, and the r-th request after them gets r plus the numbers
taken before, which is found by the run alone. Since a number is told off a name's end in one way only, two names never get
the same target. Under "skip" the others get none, under "overwrite" all get their own path, of which one result will stay.

Requests of one name are ranked in salted shares, so that a name that a third of all rows ask for isn't sorted in one task.

Defined cases: a null path gets no target; a null policy is "rename"; requests are told apart by ``order``, which has to be
unique to give each its own target; existing paths may repeat; an empty batch gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
NUMBERED = r"(?s)^(.*) \((\d{1,9})\)(\.[^./\\]+)?\z"
SPLIT = r"(?s)^(.*?)(\.[^./\\]+)?\z"


def parts(path: Column) -> tuple[Column, Column]:
    """What stands before the extension, and the extension with its dot."""
    return F.regexp_extract(path, SPLIT, 1), F.regexp_extract(path, SPLIT, 2)


def ranked(rows: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """``out``: 0, 1, ... within the keys, share after share, in the order of ``order`` within a share."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(order)) - 1
    return salted.withColumn("_w", within).join(sizes.withColumn("_before", before).drop("_n"), [*keys, "_salt"]).withColumn(out, F.col("_w") + F.col("_before")).drop("_salt", "_w", "_before")


def taken_runs(paths: DataFrame) -> DataFrame:
    """stem, ext, runs: of each name's taken numbers from 1, the runs as (free numbers below it, taken up to its end), in order."""
    numbered = paths.where(F.col("path").rlike(NUMBERED)).select(F.regexp_extract("path", NUMBERED, 1).alias("stem"), F.regexp_extract("path", NUMBERED, 3).alias("ext"), F.regexp_extract("path", NUMBERED, 2).alias("_d"))
    # a number with zeros before it is no number that is given out
    plain = numbered.where(F.col("_d").rlike(r"^[1-9]\d*\z")).select("stem", "ext", F.col("_d").try_cast("long").alias("n")).distinct()
    counted = plain.withColumn("_i", F.row_number().over(Window.partitionBy("stem", "ext").orderBy("n")))
    runs = counted.groupBy("stem", "ext", (F.col("n") - F.col("_i")).alias("free")).agg(F.max("_i").cast("long").alias("taken"))
    return runs.groupBy("stem", "ext").agg(F.array_sort(F.collect_list(F.struct("free", "taken"))).alias("runs"))


def allotted(requests: DataFrame, existing: DataFrame, order: str = "order") -> DataFrame:
    """Requests (path, policy, ``order``, and more) with ``target``. ``existing`` has the paths that are taken (path)."""
    known = existing.where("path IS NOT NULL").select("path").distinct()
    asked = requests.withColumn("_policy", F.coalesce(F.col("policy"), F.lit("rename")))
    named = asked.where(F.col("path").isNotNull() & (F.col("_policy") != "overwrite"))
    over = asked.where(F.col("path").isNull() | (F.col("_policy") == "overwrite"))
    taken = known.unionByName(over.where("path IS NOT NULL").select("path")).distinct()
    # the least of each path is found by an aggregation, whatever the number of its requests
    first = named.groupBy("path").agg(F.min(order).alias("_first")).join(taken, "path", "left_anti")
    with_first = named.join(first, "path", "left").withColumn("_own", F.coalesce(F.col("_first") == F.col(order), F.lit(False)))
    own = with_first.where("_own").withColumn("target", F.col("path"))
    rest = with_first.where(~F.col("_own"))
    skipped = rest.where("_policy = 'skip'").withColumn("target", F.lit(None).cast("string"))
    stem, ext = parts(F.col("path"))
    others = ranked(rest.where("_policy <> 'skip'").withColumns({"stem": stem, "ext": ext}), ["stem", "ext"], order, "_rank")
    runs = taken_runs(taken.unionByName(first.select("path")))
    placed = others.join(runs, ["stem", "ext"], "left")
    # numbers taken by the runs that lie below the rank-th free one
    skip = F.coalesce(F.expr("try_element_at(filter(runs, r -> r.free <= _rank), -1).taken"), F.lit(0).cast("long"))
    renamed = placed.withColumn("target", F.concat("stem", F.lit(" ("), (F.col("_rank") + 1 + skip).cast("string"), F.lit(")"), "ext")).drop("stem", "ext", "_rank", "runs")
    kept = over.withColumn("target", F.col("path"))
    out = [*requests.columns, "target"]
    return own.select(*out).unionByName(skipped.select(*out)).unionByName(renamed.select(*out)).unionByName(kept.select(*out))
