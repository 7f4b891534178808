"""Outline and sections of documents: anchors, paths, bounds, neighbours and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from .lines import by_line, explode_lines, fenced_exactly, headings


def outline(documents: DataFrame, doc: list[str], text: str = "markdown", ascii_only: bool = False) -> DataFrame:
    """doc, line, level, text, anchor: fences folded exactly."""
    return with_anchors(headings(fenced_exactly(documents.select(*doc, text), text)), doc, ascii_only).select(*doc, "line", "level", "text", "anchor")


def with_anchors(found: DataFrame, doc: list[str], ascii_only: bool = False) -> DataFrame:
    """The first heading of a slug has it as anchor, the nth gets a number n - 1."""
    slug = slugify(F.col("text"), ascii_only)
    based = found.withColumn("_base", F.when(slug == "", "section").otherwise(slug))
    n = F.row_number().over(Window.partitionBy(*doc, "_base").orderBy("line")) - 1
    return based.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))).drop("_base", "_n")


def with_sections(nodes: DataFrame, line_counts: DataFrame, doc: list[str]) -> DataFrame:
    """Adds end (the next heading of the same or a higher level, else the line count), prev and next anchors.

    One window for each level takes the place of a range join: the nearest following heading of at most that level. It
    runs backwards, since a frame that only grows is walked once.
    """
    w = by_line(doc)
    after = Window.partitionBy(*doc).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.lit(None).cast("int")
    for k in range(1, 7):
        end = F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("line"))).over(after)).otherwise(end)
    bounded = nodes.withColumns({"_end": end, "prev": F.lag("anchor").over(w), "next": F.lead("anchor").over(w)})
    return bounded.join(line_counts, doc).withColumn("end", F.coalesce("_end", F.col("n_lines").cast("int"))).drop("_end", "n_lines")


def with_paths(nodes: DataFrame, doc: list[str], out: str = "path") -> DataFrame:
    """Adds the texts of the ancestors and the heading itself: per level the last heading since a shallower one."""
    w = by_line(doc).rowsBetween(Window.unboundedPreceding, 0)
    latest = {f"_l{k}": F.last(F.when(F.col("level") == k, F.struct("line", "text")), ignorenulls=True).over(w) for k in range(1, 7)}
    shallow = {f"_s{k}": F.max(F.when(F.col("level") < k, F.col("line"))).over(w) for k in range(2, 7)}
    found = nodes.withColumns(latest | shallow)
    parts = []
    for k in range(1, 7):
        alive = F.col(f"_l{k}.line") >= F.coalesce(F.col(f"_s{k}"), F.lit(-1)) if k > 1 else F.lit(True)
        parts.append(F.when((F.col("level") >= k) & alive, F.col(f"_l{k}.text")))
    return found.withColumn(out, F.array_compact(F.array(*parts))).drop(*latest, *shallow)


def chunks(documents: DataFrame, doc: list[str], text: str = "markdown", ascii_only: bool = False) -> DataFrame:
    """All sections: anchor, level, path, start, end, prev, next and the section's text.

    A section is a slice of its document's line array, so lines are never joined to sections.
    """
    nodes = with_paths(outline(documents, doc, text, ascii_only), doc)
    lines = documents.select(*doc, F.split(F.col(text), "\r?\n").alias("_lines")).withColumn("n_lines", F.size("_lines"))
    bounded = with_sections(nodes, lines, doc)
    piece = F.slice("_lines", F.col("line") + 1, F.col("end") - F.col("line"))
    return bounded.withColumn("markdown", F.array_join(piece, "\n")).withColumnRenamed("line", "start").drop("_lines")


def chunk_by_anchor(documents: DataFrame, doc: list[str], anchor: str, text: str = "markdown") -> DataFrame:
    found = chunks(documents, doc, text).where(F.col("anchor") == anchor)
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(*doc).orderBy("start"))).where("_k = 1").drop("_k")


def chunk_by_path(documents: DataFrame, doc: list[str], path: list[str], text: str = "markdown") -> DataFrame:
    """The first section of each document with this whole path from the root."""
    found = chunks(documents, doc, text).where(F.col("path") == F.array(*[F.lit(x) for x in path]))
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(*doc).orderBy("start"))).where("_k = 1").drop("_k")


def chunk_by_range(documents: DataFrame, doc: list[str], start: int, end: int, text: str = "markdown") -> DataFrame:
    """Lines start to end, clamped; documents for which nothing is left give no row."""
    lines = documents.select(*doc, F.split(F.col(text), "\r?\n").alias("_lines"))
    a, b = F.least(F.greatest(F.lit(start), F.lit(0)), F.size("_lines")), F.least(F.greatest(F.lit(end), F.lit(0)), F.size("_lines"))
    kept = lines.withColumns({"start": a, "end": b}).where("end > start")
    return kept.withColumn("markdown", F.array_join(F.slice("_lines", F.col("start") + 1, F.col("end") - F.col("start")), "\n")).drop("_lines")


def chunk(documents: DataFrame, doc: list[str], anchor: str | None = None, path: list[str] | None = None, lines: tuple[int, int] | None = None, text: str = "markdown") -> DataFrame:
    """One of three selectors."""
    if sum(x is not None for x in (anchor, path, lines)) != 1:
        raise ValueError("give exactly one of anchor, path and lines")
    if anchor is not None:
        return chunk_by_anchor(documents, doc, anchor, text)
    return chunk_by_path(documents, doc, path, text) if path is not None else chunk_by_range(documents, doc, *lines, text)


__all__ = ["chunk", "chunk_by_anchor", "chunk_by_path", "chunk_by_range", "chunks", "explode_lines", "outline", "with_anchors", "with_paths", "with_sections"]
