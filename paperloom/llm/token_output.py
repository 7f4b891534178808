"""Token-ID output in patched frame-of-reference blocks.

A file holds the ids of one range of documents in ascending doc_id order. Each block of 512 ids stores its minimum, the
differences packed at the width that fits a percentile of them, and the rest as exceptions (place, whole difference).
An index of block starts gives random access; a document index has each document's id and number of tokens.

    "PFB1" | blocks | block starts u64 | doc ids i64 | doc lengths u64 | footer (8 x u64)
    block: minimum u32, width u8, 0 u8, exceptions u16, packed bits, exception places u16, exception differences u32

Defined cases: null and empty texts are documents of just the end id; rows that share a doc_id are all kept, ordered by
text hash, in several files if they are many; a null doc_id sorts first and is stored as the smallest 64-bit integer, read back as null; an empty table
gives no rows; texts of any length are streamed in bounded memory; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, slices

BLOCK, MAGIC, NO_ID = 512, b"PFB1", -(1 << 63)
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])
#: Ids that are packed or unpacked at a time.
CHUNK = 1 << 19


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """[n, BLOCK] integers under 2**width -> [n, BLOCK * width / 8] bytes."""
    n = len(values)
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(n, -1)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T).astype(np.uint64)
    lanes, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        lanes[k] = x & mask
    return np.ascontiguousarray(lanes.T).reshape(len(packed), BLOCK)


def encode_blocks(values: np.ndarray, percentile: float = 0.95) -> tuple[bytes, np.ndarray]:
    """Blocks of whole BLOCKs of ids, and the size of each in bytes."""
    v = values.reshape(-1, BLOCK).astype(np.uint32)
    low = v.min(axis=1)
    d = v - low[:, None]
    at = int(round(percentile * (BLOCK - 1)))
    width = bits(np.partition(d, at, axis=1)[:, at])
    limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    over = d > limit[:, None]
    n_over = over.sum(axis=1)
    sizes = HEAD.itemsize + BLOCK // 8 * width.astype(np.int64) + 6 * n_over
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(len(v), HEAD)
    head["low"], head["width"], head["exceptions"] = low, width, n_over
    out[starts[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(len(v), -1)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        packed = pack(d[mine] & np.uint32((1 << int(w)) - 1), int(w))
        out[(starts[mine] + HEAD.itemsize)[:, None] + np.arange(packed.shape[1])] = packed
    for k in np.flatnonzero(n_over):
        places = np.flatnonzero(over[k])
        a = int(starts[k]) + HEAD.itemsize + BLOCK // 8 * int(width[k])
        b = a + 2 * len(places)
        out[a:b] = places.astype("<u2").view(np.uint8)
        out[b : b + 4 * len(places)] = d[k, places].astype("<u4").view(np.uint8)
    return out.tobytes(), sizes


def bits(x: np.ndarray) -> np.ndarray:
    """Bits that each integer needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """ids of the blocks that start at these places in data."""
    raw = np.frombuffer(data, np.uint8)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(-1)
    d = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(head["width"][head["width"] > 0]):
        mine = np.flatnonzero(head["width"] == w)
        d[mine] = unpack(raw[(starts[mine] + HEAD.itemsize)[:, None] + np.arange(BLOCK // 8 * int(w))], int(w))
    for k in np.flatnonzero(head["exceptions"]):
        n, a = int(head["exceptions"][k]), int(starts[k]) + HEAD.itemsize + BLOCK // 8 * int(head["width"][k])
        places = raw[a : a + 2 * n].copy().view("<u2")
        d[k, places] = raw[a + 2 * n : a + 6 * n].copy().view("<u4")
    return d + head["low"][:, None]


class Writer:
    def __init__(self, stream, percentile: float):
        self.stream, self.percentile, self.at, self.tokens = stream, percentile, len(MAGIC), 0
        self.waiting: list[np.ndarray] = []
        self.size, self.starts, self.ids, self.lengths = 0, [], [], []
        stream.write(MAGIC)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents one after another: their ids, and how many each has."""
        self.ids.append(doc_ids)
        self.lengths.append(lengths)
        self.tokens += len(ids)
        for a in range(0, len(ids), CHUNK):
            part = ids[a : a + CHUNK]
            self.waiting.append(part)
            self.size += len(part)
            if self.size >= CHUNK:
                self.flush(False)

    def flush(self, last: bool) -> None:
        values = np.concatenate([np.zeros(0, "<u4"), *self.waiting])
        whole = len(values) // BLOCK * BLOCK
        rest = values[whole:]
        for a in range(0, whole, CHUNK):
            self.put(values[a : min(a + CHUNK, whole)])
        if last and len(rest):
            self.put(np.concatenate([rest, np.full(BLOCK - len(rest), rest.min(), "<u4")]))
            rest = rest[:0]
        self.waiting, self.size = [rest.copy()], len(rest)

    def put(self, values: np.ndarray) -> None:
        data, sizes = encode_blocks(values, self.percentile)
        self.starts.append(self.at + np.cumsum(sizes) - sizes)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.flush(True)
        starts = np.concatenate([np.zeros(0, np.int64), *self.starts]).astype("<u8")
        ids, lengths = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.ids, self.lengths))
        self.docs = len(ids)
        self.stream.write(starts.tobytes() + ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes())
        self.stream.write(np.array([len(starts), self.docs, self.tokens, self.at, BLOCK, 0, 0, 0], "<u8").tobytes())


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        store, path = common.filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(64, size - 64), "<u8")
        blocks, docs, self.tokens, self.end = (int(x) for x in foot[:4])
        if self.file.read_at(4, 0) != MAGIC or int(foot[4]) != BLOCK:
            raise ValueError(f"not a token file: {uri}")
        index = self.file.read_at(8 * (blocks + 2 * docs), self.end)
        self.starts = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.lengths = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)

    def read(self, start: int, n: int) -> np.ndarray:
        """ids start to start + n of the file."""
        n = min(n, self.tokens - start)
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        a, b = self.starts[first], self.starts[last + 1] if last + 1 < len(self.starts) else self.end
        data = self.file.read_at(int(b - a), int(a))
        values = decode_blocks(data, self.starts[first : last + 1] - a).reshape(-1)
        return values[start - first * BLOCK :][:n]


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int, percentile: float = 0.95) -> DataFrame:
    """Write ``doc_id, text`` as token files; returns the manifest: one row a file (file, base, n_docs, n_tokens).

    A task writes one file under a name of its own, so retried tasks never overwrite each other; only files of finished
    tasks are in the manifest, which the driver holds (a row for each partition) to number the tokens.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # rows that share a doc_id (or have none) may lie in several ranges, in order of their text's hash
    ordered = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, writer = TaskContext.get().partitionId(), encoder(tokenizer, end_id), None
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfb"
        store, path = common.filesystem(uri)
        for batch in batches:
            for some in slices(batch, most=ids.slice):
                if writer is None:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    stream = store.open_output_stream(path)
                    writer = Writer(stream, percentile)
                doc_ids = pc.fill_null(some.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
                writer.add(doc_ids, *ids.encode(some.column("text")))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [uri], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    made = ordered.mapInArrow(save, "part int, file string, n_docs long, n_tokens long").collect()
    base, manifest = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append((r["file"], base, r["n_docs"], r["n_tokens"]))
        base += r["n_tokens"]
    return spark.createDataFrame(manifest, "file string, base long, n_docs long, n_tokens long")


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, base in zip(batch["file"], batch["base"], strict=True):
                reader = Reader(uri)
                ends = np.cumsum(reader.lengths)
                crcs, doc, left, crc = [], 0, int(reader.lengths[0]) if len(reader.lengths) else 0, 0
                for a in range(0, reader.tokens, CHUNK):
                    data = reader.read(a, CHUNK).astype("<u4").tobytes()
                    at = 0
                    while at < len(data):
                        take = min(left, (len(data) - at) // 4)
                        crc = zlib.crc32(data[at : at + 4 * take], crc)
                        at, left = at + 4 * take, left - take
                        if left == 0:
                            crcs.append(crc)
                            doc, crc = doc + 1, 0
                            left = int(reader.lengths[doc]) if doc < len(reader.lengths) else 0
                ids = pd.array(reader.ids, dtype="Int64")
                ids[reader.ids == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": base + ends - reader.lengths, "n_tokens": reader.lengths, "ids_crc32": np.array(crcs, np.int64)})

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "file")
    return spread.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return read_digests(write(docs, common.fresh_path(spark, "tokens"), common.default_tokenizer(), end_id=2))
