"""Workbooks to Markdown: formatted texts, trimmed and visible grids, merge arrows, one table a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cellformat import format_cell
from . import grid as G

KEYS = ["path", "sheet"]


def texts(cells: DataFrame) -> DataFrame:
    """Cells with ``text``: what a reader sees."""
    return cells.where("error IS NULL").withColumn("text", F.coalesce(format_cell(F.col("raw"), F.col("format_code"), F.coalesce("date1904", F.lit(False))), F.lit("")))


def render(cells: DataFrame, merges: DataFrame, include_hidden: bool = False) -> DataFrame:
    """path, markdown, hidden_sheets, hidden_rows, hidden_cols: counts are of what was left out, after trimming."""
    seen = texts(cells)
    names = seen.select(*KEYS, "sheet_name", "sheet_hidden").distinct()
    kept = seen if include_hidden else seen.where(~F.col("sheet_hidden"))
    for f in ("row_hidden", "col_hidden"):
        kept = kept.withColumn(f, F.lit(False) if include_hidden else F.coalesce(f, F.lit(False)))
    shown, sizes = G.sparse_visible(kept.select(*KEYS, "row", "col", "text", "row_hidden", "col_hidden"), merges, KEYS)
    tables = G.sparse_tables(shown, sizes, KEYS).join(names, KEYS)
    section = F.concat(F.lit("## "), "sheet_name", F.lit("\n\n"), "markdown")
    whole = tables.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("markdown"))
    hidden = sizes.groupBy("path").agg(F.sum("hidden_rows").alias("hidden_rows"), F.sum("hidden_cols").alias("hidden_cols"))
    sheets = names.groupBy("path").agg(F.count_if("sheet_hidden").alias("hidden_sheets"))
    return whole.join(hidden, "path", "left").join(sheets, "path", "left")
