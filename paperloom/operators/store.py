"""Content-addressed conversions: identifiers, first-wins caching, lookups and queue counters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_image_name
from ..sources.storage import qualified

# Fixed value: what goes before the content where hidden parts are included.
HIDDEN_PREFIX = "opt:includeHidden "
ID = "^[a-f0-9]{64}$"


def conversion_id(content: Column, include_hidden: Column) -> Column:
    raw = content.cast("binary")
    return F.sha2(F.when(include_hidden, F.concat(F.lit(HIDDEN_PREFIX).cast("binary"), raw)).otherwise(raw), 256)


def is_conversion_id(x: Column) -> Column:
    return F.coalesce(x.rlike(ID), F.lit(False))


def shard(conversion: Column) -> Column:
    return F.substring(conversion, 1, 2)


def cached(requests: DataFrame, key: str = "conversion_id", order: list[str] | None = None) -> DataFrame:
    """Every request with ``hit`` and the first request's metadata: later ones get what was stored first."""
    w = Window.partitionBy(key).orderBy(*(order or ["arrival"]))
    first = F.row_number().over(w) == 1
    return requests.withColumns({"hit": ~first, "stored_name": F.first("name").over(w)})


def misses(requests: DataFrame, stored: DataFrame, key: str = "conversion_id") -> DataFrame:
    """Requests that still have to be converted, each content once."""
    return requests.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def hits(requests: DataFrame, stored: DataFrame, key: str = "conversion_id") -> DataFrame:
    return requests.join(stored.select(key).distinct(), key, "left_semi")


def new_paths(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Paths of a batch that aren't listed yet, the first of each."""
    fresh = batch.join(existing.select("path").distinct(), "path", "left_anti")
    return fresh.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(order))).where("_k = 1").drop("_k")


def status_counts(queue: DataFrame, status: str = "status") -> DataFrame:
    return queue.groupBy(status).agg(F.count("*").alias("n"))


class ConversionStore:
    """Conversions as a table of batches, partitioned by shard, that several writers share.

    A writer puts its rows into a batch of its own, which no one sees, and then adds the next entry to the log, a file that is
    only made if there is none of that number. If another writer was first, what that one brought is taken out of the batch
    and the next number is tried: no identifier is stored twice. Deletion is an entry too, a batch of identifiers that hides
    what was stored before it, so a deleted conversion can be stored again. Readers see the batches that the log lists; a
    lookup by identifier reads one shard of them. ``compact`` writes what is visible as one batch from which the log goes on.

    The file system of ``path`` has to be able to name a file only if the name is free: hard links of local ones, renaming
    without overwriting elsewhere.

    With a column ``error``, a row with an error is kept but doesn't count as stored: a later conversion without one is
    added and found first. An error is kept once for each identifier. Images (conversion_id, name, mime, data) are stored
    with the conversion that a batch adds, under safe names; of equal names of a conversion the first by its data.
    """

    IMAGES = "conversion_id string, name string, mime string, data binary"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, qualified(spark, path), schema
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("log", "rows", "images", "deleted"):
            self.fs.mkdirs(self._place(name))

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def entries(self) -> list[dict]:
        """The log from its last base on: version, kind (add, delete or base) and batch of each entry."""
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._place("log")))
        found = [dict(zip(("version", "kind", "batch"), (int(n[:20]), *n[21:].split("-")), strict=True)) for n in map(self._content, names) if n]
        base = max((k for k, e in enumerate(found) if e["kind"] == "base"), default=0)
        return found[base:]

    def _content(self, name: str) -> str | None:
        """Number, kind and batch of an entry; null for what isn't one."""
        if name.startswith("."):
            return None
        stream = self.fs.open(self._place(f"log/{name}"))
        try:
            return f"{name}-{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def _commit(self, version: int, kind: str, batch: str) -> bool:
        """Add an entry; False if there is one of this version already. An entry appears whole or not at all."""
        jvm, draft, final = self.spark._jvm, self._place(f"log/.draft-{batch}-{version}"), self._place(f"log/{version:020d}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(f"{kind}-{batch}".encode()))
        stream.close()
        try:
            if self.path.startswith("file:"):
                jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Paths.get(final.toUri()), jvm.java.nio.file.Paths.get(draft.toUri()))
                return True
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "AlreadyExists" in str(getattr(e, "java_exception", e)):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def _table(self, name: str, schema: str, entries: list[dict], kinds: tuple[str, ...]) -> DataFrame:
        """Rows of these entries' batches, with batch and shard."""
        batches = [e["batch"] for e in entries if e["kind"] in kinds]
        return self.spark.read.schema(f"{schema}, batch string, shard string").parquet(f"{self.path}/{name}").where(F.col("batch").isin(batches))

    def _visible(self, name: str, schema: str, entries: list[dict]) -> DataFrame:
        rows = self._table(name, schema, entries, ("add", "base"))
        if not any(e["kind"] == "delete" for e in entries):
            return rows
        versions = F.broadcast(self.spark.createDataFrame([(e["batch"], e["version"]) for e in entries], "batch string, _version long"))
        gone = self._table("deleted", "conversion_id string", entries, ("delete",)).join(versions, "batch").groupBy("shard", "conversion_id").agg(F.max("_version").alias("_gone"))
        return rows.join(versions, "batch").join(gone, ["shard", "conversion_id"], "left").where("_gone IS NULL OR _gone < _version").select(*rows.columns)

    def read(self) -> DataFrame:
        return self._visible("rows", self.schema, self.entries()).drop("batch")

    def good(self) -> DataFrame:
        rows = self.read()
        return rows.where("error IS NULL") if "error" in rows.columns else rows

    def _write(self, name: str, rows: DataFrame, batch: str) -> None:
        # a folder of its own, so that writers don't share the place of unfinished files
        rows.withColumn("shard", shard(F.col("conversion_id"))).hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(f"{self.path}/{name}/batch={batch}")

    def _new(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        """Rows that aren't stored by these entries: of an error, neither a conversion nor another error is."""
        stored = self._visible("rows", self.schema, entries)
        if "error" not in rows.columns:
            return rows.join(stored.select("conversion_id"), "conversion_id", "left_anti")
        made = rows.join(stored.where("error IS NULL").select("conversion_id"), "conversion_id", "left_anti")
        failed = stored.where("error IS NOT NULL").select("conversion_id", F.lit(True).alias("_failed")).distinct()
        return made.join(failed, "conversion_id", "left").where("error IS NULL OR _failed IS NULL").drop("_failed")

    def put(self, conversions: DataFrame, images: DataFrame | None = None) -> None:
        """Insert what isn't stored, whole or not at all. Conversions are made once, however often another writer is first."""
        rows = conversions.dropDuplicates(["conversion_id"])
        if "error" in rows.columns:
            # of one identifier's rows in a batch the one without error
            best = Window.partitionBy("conversion_id").orderBy(F.col("error").isNotNull(), "error")
            rows = conversions.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
        entries = self.entries()
        columns = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        rows = self._new(rows, entries).select(*columns)
        while True:
            batch = uuid.uuid4().hex
            self._write("rows", rows, batch)
            mine = self._table("rows", self.schema, [{"batch": batch, "kind": "add"}], ("add",))
            if images is not None:
                named = images.withColumn("name", safe_image_name(F.col("name"), F.col("mime"))).join(mine.select("conversion_id"), "conversion_id", "left_semi")
                first = Window.partitionBy("conversion_id", "name").orderBy("data")
                self._write("images", named.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("conversion_id", "name", "mime", "data"), batch)
            if mine.isEmpty() or self._commit(entries[-1]["version"] + 1 if entries else 0, "add", batch):
                return
            entries, rows = self.entries(), mine.select(*columns)
            rows = self._new(rows, entries)

    def _append(self, kind: str, batch: str) -> None:
        entries = self.entries()
        version = entries[-1]["version"] + 1 if entries else 0
        while not self._commit(version, kind, batch):
            version += 1

    def delete(self, conversions: DataFrame) -> None:
        """Hide the conversions (column conversion_id) that are stored so far, with their images; others are ignored."""
        batch = uuid.uuid4().hex
        self._write("deleted", conversions.select("conversion_id").where(is_conversion_id(F.col("conversion_id"))).distinct(), batch)
        self._append("delete", batch)

    def compact(self) -> bool:
        """Write what is visible as one batch. False, and no change, if another writer was first."""
        entries = self.entries()
        if not entries:
            return True
        batch = uuid.uuid4().hex
        self._write("rows", self._visible("rows", self.schema, entries).drop("batch", "shard"), batch)
        self._write("images", self._visible("images", self.IMAGES, entries).drop("batch", "shard"), batch)
        return self._commit(entries[-1]["version"] + 1, "base", batch)

    def _of(self, rows: DataFrame, conversion: str) -> DataFrame:
        return rows.where((F.col("shard") == conversion[:2]) & (F.col("conversion_id") == conversion))

    def get(self, conversion: str) -> DataFrame:
        """The conversion, or else its error, or no row."""
        found = self._of(self.read(), conversion)
        return (found.orderBy(F.col("error").isNotNull()) if "error" in found.columns else found).limit(1)

    def has(self, conversion: str) -> bool:
        return not self._of(self.good(), conversion).isEmpty()

    def list(self) -> DataFrame:
        """Identifier and all else that is known of each stored conversion, but its text."""
        return self.good().where(is_conversion_id(F.col("conversion_id"))).drop("markdown", "shard")

    def images(self, conversion: str) -> DataFrame:
        """name, mime, size of a conversion's images."""
        found = self._of(self._visible("images", self.IMAGES, self.entries()), conversion)
        return found.select("name", "mime", F.octet_length("data").cast("long").alias("size"))

    def image(self, conversion: str, name: str) -> DataFrame:
        """name, mime, data of one image, or no row."""
        return self._of(self._visible("images", self.IMAGES, self.entries()), conversion).where(F.col("name") == name).select("name", "mime", "data")
