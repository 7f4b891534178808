"""Web pages as a source: local files or a table of fetched pages, converted to Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.routing import is_http_url
from ..functions.text import extension_of, image_name, mime_of

MAX_IMAGES = 50


def read(spark: SparkSession, path: str) -> DataFrame:
    """HTML files below a folder, decoded: path, html."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm}").load(path)
    return files.select("path", H.decoded(F.col("content"), F.lit(None).cast("string")).alias("html"))


def convert(pages: DataFrame) -> DataFrame:
    """Adds markdown and title; pages that can't be read have a null text and an error."""
    made = pages.withColumn("markdown", H.page_markdown(F.col("html"), F.col("url")))
    error = F.when(F.col("html").isNull(), "no-content").when(F.col("url").isNotNull() & ~is_http_url(F.col("url")), "bad-base-url")
    return made.select(*[c for c in pages.columns if c != "html"], H.title(F.col("html")).alias("title"), "markdown", error.alias("error"))


def followed(pages: DataFrame, hops: int = 2) -> DataFrame:
    """Frame shells replaced by the page that their frame shows, if the table has it: a left join for each hop.

    Of several pages with one url the least html is shown, so rows don't multiply. Pages without a frame, most of them,
    take no part in the join: their null targets would all meet in one task.
    """
    known = pages.where("url IS NOT NULL").groupBy(F.col("url").alias("_url")).agg(F.min("html").alias("_html"))
    for _ in range(hops):
        target = H.frame_target(F.col("html"))
        origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
        folder = F.regexp_extract("url", r"^(https?://[^?#]*/)", 1)
        absolute = F.when(target.rlike("(?i)^https?://"), target).when(target.startswith("/"), F.concat(origin, target)).otherwise(F.concat(folder, target))
        sought = pages.withColumn("_to", absolute).withColumn("_to", F.when(F.col("_to") != F.col("url"), F.col("_to")))
        shells = sought.where("_to IS NOT NULL").join(known, F.col("_to") == F.col("_url"), "left")
        shown = shells.withColumns({"html": F.coalesce("_html", "html"), "url": F.coalesce("_url", "url")}).select(*pages.columns)
        pages = sought.where("_to IS NULL").select(*pages.columns).unionByName(shown)
    return pages


def download_plan(images: DataFrame, page: list[str], most: int = MAX_IMAGES) -> DataFrame:
    """Images to fetch (columns k, src, content_type): http only, each address once a page, the first ``most``, with names.

    The type is the response's, else that of the address; images of neither are skipped.
    """
    usable = images.where(is_http_url(F.col("src")))
    once = usable.groupBy(*page, "src").agg(F.min("k").alias("k"), F.max("content_type").alias("content_type"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(*page).orderBy("k"))).where(F.col("n") <= most)
    by_address = mime_of(F.regexp_extract("src", r"^([^?#]*)", 1))
    kind = F.coalesce("content_type", F.when(by_address != "application/octet-stream", by_address))
    return ranked.withColumn("mime", kind).where("mime IS NOT NULL").withColumn("name", image_name(F.col("n"), extension_of(F.col("mime"))))
