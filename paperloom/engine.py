"""One entry for whole conversions: files of mixed formats in, a table of Markdown, errors and identifiers out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .functions import html as H
from .functions.routing import basename, detect_format
from .operators import outline as O
from .operators import store as S
from .operators import workbook as W
from .sources import containers as N

RESULT = ["conversion_id", "path", "original_name", "format", "size", "markdown", "hidden_excluded", "error"]


def convert(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Rows (path, content) to RESULT columns. Each format is read by its own reader; what none reads is an error row.

    A file is routed by its extension, filtered before it is parsed, so a format's reader sees its own files only. Results
    are found by path and content: of two files of one path each has its own, and a file that comes twice has it twice.
    """
    named = files.select("path", "content").withColumns({"original_name": basename(F.col("path")), "format": detect_format(F.col("path")), "size": F.octet_length("content").cast("long")})
    named = named.withColumn("conversion_id", S.conversion_id(F.col("content"), F.lit(include_hidden)))
    named = named.withColumn("_key", F.concat_ws(":", "conversion_id", "path"))
    head = named.drop("content")
    named = named.drop("path").withColumnRenamed("_key", "path")  # readers name a file by this
    none = F.lit(None).cast("struct<sheets:long,rows:long,cols:long>")
    made = []
    for kind in N.READERS:
        mine = named.where(F.col("format") == kind)
        cells, merges = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in N.read_sheets(mine, kind))  # parsed once, used often
        hidden = F.struct(F.lit(0).cast("long") if include_hidden else F.col("hidden_sheets"), "hidden_rows", "hidden_cols").cast("struct<sheets:long,rows:long,cols:long>")
        errors = cells.where("error IS NOT NULL AND sheet IS NULL").select("path", F.lit(None).cast("string").alias("markdown"), none.alias("hidden_excluded"), "error")
        made.append(W.render(cells, merges, include_hidden).select("path", "markdown", hidden.alias("hidden_excluded"), F.lit(None).cast("string").alias("error")).unionByName(errors))
    for kind in N.TEXT_READERS:
        made.append(N.read_text(named.where(F.col("format") == kind), kind).select("path", "markdown", none.alias("hidden_excluded"), "error"))
    pages = named.where("format = 'html'").withColumn("html", H.decoded(F.col("content"), F.lit(None).cast("string")))
    made.append(pages.select("path", H.page_markdown(F.col("html"), F.lit(None).cast("string")).alias("markdown"), none.alias("hidden_excluded"), F.lit(None).cast("string").alias("error")))
    results = made[0]
    for more in made[1:]:
        results = results.unionByName(more)
    joined = head.join(results.withColumnRenamed("path", "_key").dropDuplicates(["_key"]), "_key", "left")
    unread = F.when(F.col("format").isNull(), "unsupported-format").when(F.col("markdown").isNull() & F.col("error").isNull(), "no-reader").otherwise(F.col("error"))
    return joined.withColumn("error", unread).select(*RESULT)


def convert_folder(spark: SparkSession, path: str, include_hidden: bool = False) -> DataFrame:
    return convert(N.files(spark, path), include_hidden)


def sections(conversions: DataFrame) -> DataFrame:
    """All sections of converted documents, by conversion_id."""
    return O.chunks(conversions.where("markdown IS NOT NULL"), ["conversion_id"])
