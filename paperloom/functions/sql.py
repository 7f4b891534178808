"""Names for SQL users: functions that Spark lacks are registered on a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import html, text


def register(spark: SparkSession) -> list[str]:
    """Register and list the names."""
    found = {
        "md_nfc": text.nfc, "md_nfkc": text.nfkc, "html_decode": html.decoded, "html_content": html.main_content,
        "html_sanitize": html.sanitized, "html_to_markdown": html.to_markdown, "page_to_markdown": html.page_markdown,
    }
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)
