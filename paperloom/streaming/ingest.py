"""Continuous ingestion: new files are converted once, by content; queue counters follow progress.

The queue's concurrency is the cluster's; ``maxFilesPerTrigger`` bounds a batch. A conversion that fails is a row with an
error; it is retried by the next batch that holds its content, since only conversions without error count as stored. A file
above the limit of size is a row with an error too, and its content isn't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import store as S

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files as they appear below a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)


def too_large(files: DataFrame, schema: StructType) -> DataFrame:
    """Rows of a store's schema for files that aren't converted; identified by path and length, as the content isn't read."""
    known = {"conversion_id": F.sha2(F.concat_ws(":", F.lit("too-large"), "path", F.col("length").cast("string")), 256), "path": F.col("path"), "size": F.col("length"), "error": F.lit("file-too-large")}
    return files.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def new_content(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each content once within the watermark, with its identifier."""
    keyed = stream.withColumn("conversion_id", S.conversion_id(F.col("content"), F.lit(False)))
    return keyed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["conversion_id"])


def ingest(spark: SparkSession, folder: str, store: S.ConversionStore, convert: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_trigger: int = 1000, max_bytes: int = 50 * 1024 * 1024) -> StreamingQuery:
    """Run conversions of a folder into a store. ``convert`` maps (conversion_id, path, content) to the store's columns.

    A batch replayed after a failure adds nothing: what is stored already is left out by an anti join. Files above
    ``max_bytes`` need a store with a column ``error``, else the batch fails.
    """

    def one(batch: DataFrame, _: int) -> None:
        fits = batch.where(F.col("length") <= max_bytes)
        keyed = fits.withColumn("conversion_id", S.conversion_id(F.col("content"), F.lit(False)))
        store.put(convert(keyed.dropDuplicates(["conversion_id"])))
        large = batch.where(F.col("length") > max_bytes).select("path", "length")
        columns = StructType([f for f in store.read().schema if f.name != "shard"])
        if "error" in columns.names:
            store.put(too_large(large, columns))
        elif not large.isEmpty():
            raise ValueError("files above the limit of size, and the store has no column for errors")

    stream = arriving(spark, folder, files_per_trigger)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, delay: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts by status and window of a stream of status events (ts, status)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n"))
