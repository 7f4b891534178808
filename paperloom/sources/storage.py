"""Places that driver and executors both reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority of the file system that Spark reads it from: without any, the default one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a qualified address, usable in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share, ``spark.checkpoint.dir``. Only a local session may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/paperloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{qualified(spark, found).rstrip('/')}/{label}-{uuid.uuid4().hex}"
