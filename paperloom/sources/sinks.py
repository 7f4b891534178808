"""Results as files: Markdown beside or below a folder, images in a folder named for their document.

Files are written by the tasks that hold the rows, through the file system of the folder's address, under their final
names: a task that is retried writes the same bytes to the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.routing import images_folder, markdown_path
from ..operators.names import allotted
from .storage import filesystem, qualified


def _put(folder: str, name_column: str, data_column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for batch in batches:
            sizes = []
            for name, data in zip(batch[name_column], batch[data_column], strict=True):
                path = f"{root.rstrip('/')}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                raw = data.encode() if isinstance(data, str) else bytes(data)
                with store.open_output_stream(path) as f:
                    f.write(raw)
                sizes.append(len(raw))
            yield pd.DataFrame({"file": batch[name_column], "bytes": sizes})

    return run


def write_markdown(conversions: DataFrame, folder: str, policy: str = "rename", existing: DataFrame | None = None) -> DataFrame:
    """One .md file a document that has Markdown. Returns what was written (file, bytes); an action runs it.

    Sources that differ in their extension alone, and names that ``existing`` (path, below the folder) has, get names by the
    policy (``names.allotted``); rows of one source path are one file. A task that runs again writes the same names.
    """
    named = conversions.where("markdown IS NOT NULL").select(F.ltrim(markdown_path(F.col("path"), F.lit("")), F.lit("/")).alias("path"), F.col("path").alias("order"), "markdown", F.lit(policy).alias("policy"))
    taken = named.limit(0).select("path") if existing is None else existing
    placed = allotted(named, taken).where("target IS NOT NULL").select(F.col("target").alias("file"), "markdown")
    return placed.mapInPandas(_put(qualified(conversions.sparkSession, folder), "file", "markdown"), "file string, bytes long")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Images (path, name, data) below ``<document>_images/``."""
    named = images.select(F.concat(images_folder(F.col("path")), F.lit("/"), "name").alias("file"), "data")
    return named.mapInPandas(_put(qualified(images.sparkSession, folder), "file", "data"), "file string, bytes long")
