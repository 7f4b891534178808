"""Documents as lines: the table that outline, tables of contents and repairs are computed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_inline, trim_edges

# Patterns of headings, fences and lines of a table of contents, and the dots that lead to page numbers.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*\z"
FENCE = r"^\s{0,3}(```+|~~~+)"
LEADERS = ".·․‥…"
TOC = r"^(#{1,6}\s+)?(.+?)\s*[" + LEADERS + r"]{4,}\s*(\d+)\z"


def by_line(doc: list[str]) -> Window:
    return Window.partitionBy(*doc).orderBy("line")


def explode_lines(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """One row a line: the document's other columns, line (from 0) and raw."""
    return documents.select("*", F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "raw")).drop(text)


def joined_lines(lines: DataFrame, doc: list[str], raw: str = "raw", out: str = "markdown") -> DataFrame:
    return lines.groupBy(*doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", raw))), lambda x: x[raw]), "\n").alias(out))


def fence_states(raws: Column, chunk: int = 256) -> Column:
    """For each line whether it is a fence or inside one: a fold, since only the opening character closes a fence.

    States grow by chunks of lines, so that a long document's array isn't copied for each line.
    """
    marks = F.transform(raws, lambda raw: F.substring(F.regexp_extract(raw, FENCE, 1), 1, 1))
    none = F.array().cast("array<boolean>")

    def step(acc: Column, mark: Column) -> Column:
        is_fence = mark != ""
        after = F.when(is_fence & (acc["open"] == ""), mark).when(is_fence & (acc["open"] == mark), F.lit("")).otherwise(acc["open"])
        return F.struct(after.alias("open"), F.concat(acc["inside"], F.array(is_fence | (acc["open"] != ""))).alias("inside"))

    def part(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["open"].alias("open"), none.alias("inside")), step)
        grown = F.transform(F.array(done), lambda d: F.struct(d["open"].alias("open"), F.concat(acc["parts"], F.array(d["inside"])).alias("parts")))
        return F.get(grown, F.lit(0))

    def whole(of_all: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(of_all), F.lit(1)), F.lit(chunk))
        start = F.struct(F.lit("").alias("open"), F.array().cast("array<array<boolean>>").alias("parts"))
        return F.aggregate(F.transform(starts, lambda at: F.slice(of_all, at, chunk)), start, part, lambda acc: F.flatten(acc["parts"]))

    # in an array of one, so that marks are found once
    return F.get(F.transform(F.array(marks), whole), F.lit(0))


def fenced_exactly(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """explode_lines with ``fenced`` from the fold."""
    lines = F.split(F.col(text), "\r?\n")
    zipped = F.arrays_zip(lines.alias("raw"), fence_states(lines).alias("fenced"))
    return documents.select("*", F.posexplode(zipped).alias("line", "_x")).select("*", F.col("_x.raw").alias("raw"), F.col("_x.fenced").alias("fenced")).drop(text, "_x")


def headings(lines: DataFrame) -> DataFrame:
    """Lines outside fences that are headings, with level and text."""
    level = F.length(F.regexp_extract("raw", HEADING, 1))
    found = lines.withColumns({"level": level, "text": F.trim(strip_inline(F.regexp_extract("raw", HEADING, 2)))})
    outside = ~F.col("fenced") if "fenced" in lines.columns else F.lit(True)
    return found.where(outside & (F.col("level") > 0) & (F.col("text") != ""))


def toc_entries(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Adds ``rendered``: a line of a table of contents as a nested list item, other lines as they are."""
    marker, title, page = (F.regexp_extract("raw", TOC, k) for k in (1, 2, 3))
    entry = F.col("raw").rlike(TOC)
    level = F.when(entry & (marker != ""), F.length(F.regexp_replace(marker, r"\s+\z", "")))
    ranked = lines.withColumns({"_level": level, "_entry": entry})
    depth = F.when(F.col("_level").isNotNull(), F.dense_rank().over(Window.partitionBy(*doc).orderBy(F.asc_nulls_last("_level"))) - 1).otherwise(0)
    ranked = ranked.withColumn("depth", depth)
    item = F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.lit("- "), title, F.lit(" — "), page)
    return ranked.withColumn("rendered", F.when(F.col("_entry"), item).otherwise(F.col("raw"))).drop("_level", "_entry")


def demote_false_headings(lines: DataFrame, doc: list[str], raw: str = "raw") -> DataFrame:
    """Adds ``demoted``: headings that end like prose, or stand in a run of three or more of one level, lose their marks."""
    level = F.length(F.regexp_extract(raw, HEADING, 1))
    filled = lines.withColumns({"_level": level, "_blank": F.regexp_replace(F.col(raw), r"\s+", "") == ""})
    w = Window.partitionBy(*doc, "_blank").orderBy("line")
    change = F.coalesce(F.lag("_level").over(w) != F.col("_level"), F.lit(True)) | (F.col("_level") == 0)
    islands = filled.withColumn("_island", F.count_if(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count("*").over(Window.partitionBy(*doc, "_blank", "_island"))
    prose = F.regexp_extract(raw, HEADING, 2).rlike(r"[.。]\z")
    false = (F.col("_level") > 0) & (prose | (run >= 3))
    return islands.withColumn("demoted", F.when(false, F.regexp_extract(raw, HEADING, 2)).otherwise(F.col(raw))).drop("_level", "_blank", "_island")


def repair(documents: DataFrame, doc: list[str], text: str = "markdown") -> DataFrame:
    """Whole clean-up of converted text: edges, table of contents, false headings."""
    lines = explode_lines(documents.select(*doc, text), text).withColumn("raw", trim_edges(F.col("raw")))
    entries = toc_entries(lines, doc).select(*doc, "line", F.col("rendered").alias("raw"))
    return joined_lines(demote_false_headings(entries, doc), doc, "demoted", text)


def drop_empty_rows(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Without empty body rows of pipe tables outside fences; a row before a separator is a header and stays."""
    trimmed = F.trim(F.regexp_replace("raw", r"^\s+|\s+\z", ""))
    row = trimmed.startswith("|") & trimmed.endswith("|") & (F.length(trimmed) >= 2)
    inner = F.expr("substr(_t, 2, length(_t) - 2)")
    separator = lambda c: c.rlike(r"^\|(\s*:?-{3,}:?\s*\|)+\z")
    bare = F.regexp_replace(F.regexp_replace(inner, r"[*_]", ""), r"(?i)<br\s*/?>|&nbsp;", "")
    marked = lines.withColumn("_t", trimmed).withColumns({"_row": row, "_fence": F.col("_t").startswith("```")})
    w = by_line(doc)
    marked = marked.withColumns({"_next": F.lead("_t").over(w), "_open": F.count_if("_fence").over(w.rowsBetween(Window.unboundedPreceding, -1)) % 2 == 1})
    empty = F.col("_row") & ~separator(F.col("_t")) & (F.regexp_replace(bare, r"[|\s]", "") == "")
    header = F.coalesce(separator(F.col("_next")), F.lit(False))
    return marked.where(F.col("_open") | F.col("_fence") | ~empty | header).drop("_t", "_row", "_fence", "_next", "_open")
