"""Greedy folds over the text runs of a page: the state is what was kept so far, so they aren't windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_overdraws(runs: DataFrame, page: list[str]) -> DataFrame:
    """Without runs drawn again near a kept run of the same font and text: within max(2, a quarter of the height).

    A fold over each group's ordered array in the JVM, partitioned by (page, font, text).
    """
    ordered = runs.groupBy(*page, "font", "text").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "width", "height"))).alias("_runs"))

    def near(k: Column, r: Column) -> Column:
        limit = F.greatest(F.lit(2.0), F.lit(0.25) * F.greatest(k["height"], r["height"]))
        return (F.abs(k["x"] - r["x"]) <= limit) & (F.abs(k["y"] - r["y"]) <= limit)

    empty = F.array().cast("array<struct<seq:int,x:double,y:double,width:double,height:double>>")
    kept = F.aggregate("_runs", empty, lambda acc, r: F.when(F.exists(acc, lambda k: near(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    return ordered.select(*page, "font", "text", F.explode(kept).alias("_r")).select(*page, "_r.*", "text", "font")


def merge_adjacent(runs: DataFrame, page: list[str]) -> DataFrame:
    """Joins runs that touch: equal height, within 0.5 of the group's first y, a gap of at most 1; fonts don't matter.

    A fold over each page's ordered array: the state is the finished groups and the open one.
    """
    run = "struct<seq:int,x:double,y:double,width:double,height:double,text:string,font:string>"
    fields = ["seq", "x", "y", "width", "height", "text", "font"]
    ordered = runs.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{run}>").alias("_runs"))
    start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(None).cast(run).alias("open"))

    def step(acc: Column, r: Column) -> Column:
        last = acc["open"]
        touch = (last["height"] == r["height"]) & (F.abs(r["y"] - last["y"]) <= 0.5) & (F.abs(r["x"] - (last["x"] + last["width"])) <= 1)
        grown = F.struct(last["seq"], last["x"], last["y"], r["x"] + r["width"] - last["x"], last["height"], F.concat(last["text"], r["text"]), last["font"]).cast(run)
        joined = F.struct(acc["done"].alias("done"), grown.alias("open"))
        opened = F.struct(F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), r.alias("open"))
        return F.when(F.coalesce(touch, F.lit(False)), joined).otherwise(opened)

    merged = F.aggregate("_runs", start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return ordered.select(*page, F.explode(merged).alias("_r")).select(*page, "_r.*")


def style_tags(runs: DataFrame, doc: list[str]) -> DataFrame:
    """Text of each paragraph with tags opened and closed only where a style flag changes (strong, then em, then del)."""
    w = Window.partitionBy(*doc).orderBy("seq")
    flags = [("strong", "bold"), ("em", "italic"), ("del", "struck")]
    change = F.lit(False)
    for _, c in flags:
        change = change | (F.coalesce(F.lag(c).over(w), F.lit(False)) != F.col(c))
    islands = runs.withColumn("_new", change | (F.row_number().over(w) == 1)).withColumn("_island", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*doc, "_island", *[c for _, c in flags]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("_t"))
    text = F.col("_t")
    for tag, c in reversed(flags):
        text = F.when(F.col(c), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    tagged = spans.withColumn("_h", text)
    return tagged.groupBy(*doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_island", "_h"))), lambda x: x["_h"]), "").alias("html"))


def list_groups(paragraphs: DataFrame, doc: list[str]) -> DataFrame:
    """Consecutive paragraphs of a list become one list; anything else closes it. Columns: seq, is_list, text."""
    w = Window.partitionBy(*doc).orderBy("seq")
    starts = ~F.col("is_list") | ~F.coalesce(F.lag("is_list").over(w), F.lit(False))
    islands = paragraphs.withColumn("_s", starts).withColumn("group", F.count_if("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = islands.groupBy(*doc, "group", "is_list").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "</li><li>").alias("_t"), F.count("*").alias("items"))
    html = F.when(F.col("is_list"), F.concat(F.lit("<ul><li>"), F.col("_t"), F.lit("</li></ul>"))).otherwise(F.concat(F.lit("<p>"), F.col("_t"), F.lit("</p>")))
    return made.select(*doc, "group", "items", html.alias("html"))

