"""Quality metrics of converted documents and comparisons of two converters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"(?m)^\s*\|(?:\s*:?-{3,}:?\s*\|)+\s*$"
ROW = r"(?m)^\s*\|.*\|\s*$"
#: Glyphs that are counted one by one.
CENSUS = "●○■□▪•➢✗✓☒☑◆"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def table_statistics(text: Column) -> dict[str, Column]:
    return {
        "pipe_tables": count_of(text, SEPARATOR),
        "pipe_rows": count_of(text, ROW),
        "html_tables": count_of(text, r"(?i)<table[\s>]"),
        "html_rows": count_of(text, r"(?i)<tr[\s>]"),
        "col_spans": count_of(text, r"(?i)colspan\s*="),
        "row_spans": count_of(text, r"(?i)rowspan\s*="),
    }


def heading_count(text: Column) -> Column:
    return count_of(text, r"(?m)^#{1,6}\s")


def glyph_counts(documents: DataFrame, text: str, glyphs: str = CENSUS) -> DataFrame:
    """How often each glyph occurs over all documents; documents are pre-aggregated before the shuffle."""
    each = documents.select(F.explode(F.array(*[F.struct(F.lit(g).alias("glyph"), (F.length(text) - F.length(F.replace(F.col(text), F.lit(g), F.lit("")))).alias("n")) for g in glyphs])).alias("_g"))
    return each.groupBy("_g.glyph").agg(F.sum("_g.n").cast("long").alias("n"))


def residual_symbols(text: Column) -> Column:
    """Private-use characters that no table maps."""
    return F.length(F.regexp_replace(text, "[^\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}]", "")).cast("long")


def residual_tokens(left: DataFrame, right: DataFrame, keys: list[str], token: str = "[가-힣]{2,}", text: str = "text") -> DataFrame:
    """Distinct tokens of the left text that don't occur in the right one once white space is gone, by document."""
    a = left.select(*keys, F.array_distinct(F.regexp_extract_all(text, F.lit(token), F.lit(0))).alias("_tokens"))
    b = right.select(*keys, F.regexp_replace(text, r"\s+", "").alias("_plain"))
    found = a.join(b, keys).select(*keys, F.explode("_tokens").alias("token"), "_plain")
    return found.where(~F.contains("_plain", "token")).select(*keys, "token")


def numbers(text: Column) -> Column:
    """Distinct digit strings, separators of thousands and decimals removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,.]*"), F.lit(0)), lambda x: F.regexp_replace(x, "[,.]", "")))


def number_difference(left: Column, right: Column) -> Column:
    return F.array_except(numbers(left), numbers(right))


def compare(a: DataFrame, b: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Side-by-side measures of two converters' results without the texts themselves."""
    measure = lambda df, n: df.select(*keys, F.length(text).cast("long").alias(f"chars_{n}"), F.size(F.split(F.trim(text), r"\s+")).cast("long").alias(f"words_{n}"), *[c.alias(f"{k}_{n}") for k, c in table_statistics(F.col(text)).items()], heading_count(F.col(text)).alias(f"headings_{n}"))
    both = measure(a, "a").join(measure(b, "b"), keys)
    return both.withColumn("delta_percent", F.when(F.col("chars_a") > 0, F.round((F.col("chars_b") - F.col("chars_a")) * 100.0 / F.col("chars_a"), 1)))


def verify_grids(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and arrows that agree or differ, and rows whose width isn't the table's."""
    on = [*keys, "row", "col"]
    both = expected.select(*on, F.col("text").alias("e")).join(actual.select(*on, F.col("text").alias("a")), on, "full_outer")
    arrow = F.col("e").isin("←", "↑")
    same = F.coalesce(F.col("e") == F.col("a"), F.lit(False))
    return both.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in (("cells_ok", ~F.coalesce(arrow, F.lit(False)) & same), ("cells_diff", ~F.coalesce(arrow, F.lit(False)) & ~same), ("arrows_ok", F.coalesce(arrow, F.lit(False)) & same), ("arrows_diff", F.coalesce(arrow, F.lit(False)) & ~same))])


def folder_rollup(files: DataFrame, path: str = "path") -> DataFrame:
    """Number of files below each folder prefix."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def files_under(files: DataFrame, folder: str, path: str = "path") -> DataFrame:
    return files.where(F.col(path).startswith(folder.rstrip("/") + "/"))
