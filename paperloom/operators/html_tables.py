"""HTML tables inside Markdown text as rows: nesting and spans resolved in a text's own row.

A text is one row all along, so nothing is shuffled or sorted: a stack over its tags (``functions.tables``, over Arrow batches)
gives its outermost tables, with each table in a cell as a line of that cell's text. Only cells of outermost tables become
rows. Cells that come as rows (``grids``) are laid out by a fold over a table's rows.

Defined cases: a null text has no tables; a table that is never closed, and with it all up to the document's end, stays as
it is; a closing tag without an opening one is ignored; a table in no cell of the table around it goes; cells that aren't
closed end where the next cell or row begins; documents are told apart by ``doc``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions import tables as T
from ..functions.tables import LEFT, TAG, UP
from ..functions.text import by_row, once

# Control characters by which tags were marked; they are text like any other now.
ESCAPE, TABLE, MARKS = "\x01", "\x08", "\x01\x02\x03\x04\x05\x06\x07\x08\x0e"
#: So many steps are summed up at a time: a fold that appends to an array copies it.
STRETCH = 512
CELL = StructType().add("text", StringType()).add("col_span", IntegerType()).add("row_span", IntegerType())
ARROW_CELL = pa.struct([("text", pa.string()), ("col_span", pa.int32()), ("row_span", pa.int32())])
HAS_TABLE = r"(?i)<table[\s/>]"


@F.arrow_udf(ArrayType(ArrayType(ArrayType(CELL))))
def cells_of(texts: pa.Array) -> pa.Array:
    return by_row(T.tables, pa.list_(pa.list_(pa.list_(ARROW_CELL))), texts)


@F.arrow_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def rectangles_of(texts: pa.Array) -> pa.Array:
    return by_row(T.rectangles, pa.list_(pa.list_(pa.list_(pa.string()))), texts)


@F.arrow_udf(StringType())
def normalized_text(texts: pa.Array) -> pa.Array:
    return by_row(T.normalized, pa.string(), texts)


def depths(steps: Column) -> Column:
    """0 and, for each entry of 1 or -1, the sum up to it, which never falls below zero.

    Long arrays are folded in stretches: what one does to a sum x is greatest(x + all, least), so their begins are known first.
    """

    def fold(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda out, s: F.array_append(out, F.greatest(F.lit(0), F.element_at(out, -1) + s)))

    def stretched(steps: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRETCH).cast("int")), lambda i: F.slice(steps, i * STRETCH + 1, F.lit(STRETCH)))

        def folded(cut: Column) -> Column:
            none = F.struct(F.lit(0).alias("all"), F.lit(0).alias("least"))
            effects = F.transform(cut, lambda c: F.aggregate(c, none, lambda acc, s: F.struct((acc["all"] + s).alias("all"), F.greatest(F.lit(0), acc["least"] + s).alias("least"))))
            starts = F.aggregate(effects, F.array(F.lit(0)), lambda out, e: F.array_append(out, F.greatest(F.element_at(out, -1) + e["all"], e["least"])))
            sums = once(starts, lambda begin: F.transform(cut, lambda c, i: F.slice(fold(c, F.get(begin, i)), F.lit(2), F.size(c))))
            return F.concat(F.array(F.lit(0)), F.flatten(sums))

        return once(cut, folded)

    return F.when(F.size(steps) > STRETCH, stretched(steps)).otherwise(fold(steps, F.lit(0)))


def exploded(rows: DataFrame, keys: list[str], array: str, at: str, entry: str) -> DataFrame:
    """Entries of an array that was just computed; the filter that Spark puts before a plain explode computes it once more."""
    return rows.select(*keys, F.posexplode_outer(array).alias(at, entry)).where(F.col(at).isNotNull())


def placed_tags(documents: DataFrame, doc: list[str], text: str) -> DataFrame:
    """doc, top (from 1), rows: the cells (text, col_span, row_span) of each outermost table that is closed."""
    found = documents.where(F.col(text).rlike(HAS_TABLE)).select(*doc, cells_of(F.col(text)).alias("_t"))
    return exploded(found, doc, "_t", "top", "rows").withColumn("top", F.col("top") + 1)


def top_cells(placed: DataFrame, doc: list[str]) -> DataFrame:
    """doc, top (number of an outermost table), row, cell, text, col_span, row_span; cell -1 marks a row's begin."""
    rows = exploded(placed, [*doc, "top"], "rows", "row", "_c")
    begins = rows.selectExpr(*doc, "top", "row", "-1 AS cell", "cast(null AS string) AS text", "cast(null AS int) AS col_span", "cast(null AS int) AS row_span")
    each = exploded(rows, [*doc, "top", "row"], "_c", "cell", "_c")
    return begins.unionByName(each.select(*doc, "top", "row", "cell", "_c.text", "_c.col_span", "_c.row_span"))


def placed_rows(rows: Column) -> Column:
    """Rows of (text, col_span, row_span) to rows of texts, as wide as each goes: the fold that resolves spans.

    The state is how many more rows each column is covered for. A cell goes to the first column that isn't; covered ones
    before it, and those right behind the last cell, show an arrow and have a row less to go. Columns of a row-spanning cell
    are covered anew, whatever they were.
    """

    def covered(left: Column, col: Column) -> Column:
        rest = F.slice(left, col + 1, F.greatest(F.size(left) - col, F.lit(0)))
        free = F.array_position(F.transform(rest, lambda x: x > 0), F.lit(False)).cast("int")
        return F.when(free == 0, F.size(rest)).otherwise(free - 1)

    def drained(acc: Column, run: Column) -> tuple[Column, Column]:
        left = F.transform(acc["left"], lambda x, i: F.when((i >= acc["col"]) & (i < acc["col"] + run), x - 1).otherwise(x))
        return left, F.concat(acc["out"], F.array_repeat(F.lit(UP), run))

    def put(acc: Column, cell: Column) -> Column:
        def with_run(run: Column) -> Column:
            left, out = drained(acc, run)
            start = acc["col"] + run
            end = start + cell["col_span"]
            over = F.transform(F.sequence(F.lit(0), F.greatest(F.size(left), end) - 1), lambda i: F.when((i >= start) & (i < end), cell["row_span"] - 1).otherwise(F.coalesce(F.get(left, i), F.lit(0))))
            return F.struct(end.alias("col"), F.when(cell["row_span"] > 1, over).otherwise(left).alias("left"), F.concat(out, F.array(cell["text"]), F.array_repeat(F.lit(LEFT), cell["col_span"] - 1)).alias("out"))

        return once(covered(acc["left"], acc["col"]), with_run)

    def rest_of_row(acc: Column, done: Column) -> Column:
        def with_run(run: Column) -> Column:
            left, out = drained(acc, run)
            return F.struct(left.alias("left"), F.concat(done, F.array(out)).alias("done"))

        return once(covered(acc["left"], acc["col"]), with_run)

    def row(state: Column, cells: Column) -> Column:
        begin = F.struct(F.lit(0).alias("col"), state["left"].alias("left"), F.array().cast("array<string>").alias("out"))
        folded = once(F.aggregate(cells, begin, put), lambda acc: rest_of_row(acc, state["done"]))
        # nothing from above and nothing that spans: the cells are the row
        free = ~F.exists(state["left"], lambda x: x > 0) & ~F.exists(cells, lambda c: (c["col_span"] > 1) | (c["row_span"] > 1))
        as_is = F.struct(state["left"].alias("left"), F.concat(state["done"], F.array(F.transform(cells, lambda c: c["text"]))).alias("done"))
        return F.when(free, as_is).otherwise(folded)

    start = F.struct(F.array().cast("array<int>").alias("left"), F.array().cast("array<array<string>>").alias("done"))
    return F.aggregate(rows, start, row, lambda state: state["done"])


def rectangle(rows: Column) -> Column:
    """Rows of (text, col_span, row_span) as rows of texts of one width; those too short end with blanks.

    A table in which nothing spans is the rows that it has.
    """
    spanned = F.exists(rows, lambda r: F.exists(r, lambda c: (c["col_span"] > 1) | (c["row_span"] > 1)))
    lines = F.when(spanned, placed_rows(rows)).otherwise(F.transform(rows, lambda r: F.transform(r, lambda c: c["text"])))
    filled = lambda lines: once(F.array_max(F.transform(lines, F.size)), lambda width: F.transform(lines, lambda x: F.when(F.size(x) < width, F.concat(x, F.array_repeat(F.lit(""), width - F.size(x)))).otherwise(x)))
    return once(lines, filled)


def positions(rectangles: DataFrame, keys: list[str], lines: str) -> DataFrame:
    """keys, row, col, text, from 0."""
    return exploded(exploded(rectangles, keys, lines, "row", "_line"), [*keys, "row"], "_line", "col", "text")


def grids(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, cell, text, col_span, row_span; cell -1 marks a row's begin) as rectangles: keys, row, col, text, from 0.

    Rows of a rectangle that are too short end with blanks.
    """
    own = F.struct("cell", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("col_span").cast("int"), F.lit(1)).alias("col_span"), F.coalesce(F.col("row_span").cast("int"), F.lit(1)).alias("row_span"))
    rows = cells.groupBy(*keys, "row").agg(F.filter(F.array_sort(F.collect_list(own)), lambda x: x["cell"] >= 0).alias("_c"))
    tables = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "_c"))), lambda x: x["_c"]).alias("_rows"))
    return positions(tables.select(*keys, once(F.col("_rows"), rectangle).alias("_lines")), keys, "_lines")


def tables(documents: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """Outermost tables of each document as rectangles: doc, top (from 1), row, col, text."""
    found = documents.where(F.col(text).rlike(HAS_TABLE)).select(*doc, rectangles_of(F.col(text)).alias("_t"))
    return positions(exploded(found, doc, "_t", "top", "_lines").withColumn("top", F.col("top") + 1), [*doc, "top"], "_lines")


def normalized(documents: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """doc and the text with each outermost table as a pipe table; one without cells, and all else, stays as it is."""
    return documents.select(*doc, normalized_text(F.col(text)).alias(text))
