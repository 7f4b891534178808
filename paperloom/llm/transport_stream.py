"""Media columns: payloads of 8-bit samples in MPEG transport streams (ISO/IEC 13818-1).

``mux`` writes a program association table, a program map table and packetized elementary stream (PES) units of 8192
samples with presentation times at 8000 samples a second. Every fourth unit is a random access point: tables are
repeated, the first packet carries the indicator and a clock reference. ``demux`` parses the tables and checks their
CRCs, checks continuity counters, reassembles the units, and returns samples, timestamps and random access points.

Defined cases: null and empty texts are 64 zero bytes of payload; a text of any length is stored whole, timestamps wrap
at 33 bits and are unwrapped when read; repeated rows give equal values; a null doc_id stays null; an empty table gives no
rows; extra columns are ignored; damaged streams raise ValueError in ``demux`` (or count continuity errors).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PACKET, UNIT, EVERY, RATE, CLOCK = 188, 8192, 4, 8000, 90_000
PAT_PID, PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0, 0x100, 0x101, 1, 0x06, 0xBD
PES_HEADER, WRAP = 14, 1 << 33


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg(head))


def table_packet(pid: int, made: bytes) -> np.ndarray:
    raw = struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + made
    return np.frombuffer(raw + b"\xff" * (PACKET - len(raw)), np.uint8)


PAT = table_packet(PAT_PID, section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = table_packet(PMT_PID, section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def pts_bytes(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29 & 0x0E), (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def packets(pes: bytes, pid: int, counter: int, random_access: bool, pts: int) -> np.ndarray:
    """The packets of one unit: clock and indicator in the first, stuffing where the last isn't full."""
    field_size = 8 if random_access else 0
    room = PACKET - 4 - field_size
    first = min(room, len(pes))
    whole, tail = divmod(len(pes) - first, PACKET - 4)
    out = np.full((1 + whole + bool(tail), PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, pid >> 8, pid & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(len(out))) & 15
    out[0, 1] |= 0x40
    raw = np.frombuffer(pes, np.uint8)
    if random_access or first < room:
        size = PACKET - 4 - first
        out[0, 3] |= 0x20
        out[0, 4] = size - 1
        if size > 1:
            out[0, 5] = 0
        if random_access:
            out[0, 5] = 0x50
            out[0, 6:12] = np.frombuffer(struct.pack(">Q", pts << 15 | 0x7E00)[2:], np.uint8)
    out[0, PACKET - first :] = raw[:first]
    out[1 : 1 + whole, 4:] = raw[first : first + whole * (PACKET - 4)].reshape(-1, PACKET - 4)
    if tail:
        size = PACKET - 4 - tail
        out[-1, 3] |= 0x20
        out[-1, 4] = size - 1
        if size > 1:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = raw[len(raw) - tail :]
    return out


def mux(payload: bytes) -> bytes:
    made, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        chunk, pts, access = payload[at : at + UNIT], at * CLOCK // RATE % WRAP, k % EVERY == 0
        if access:
            both = np.stack([PAT, PMT])
            both[:, 3] |= tables & 15
            made.append(both)
            tables += 1
        pes = struct.pack(">IHHB", 0x100 | STREAM_ID, len(chunk) + 8, 0x8080, 5) + pts_bytes(pts) + chunk
        made.append(packets(pes, ES_PID, counter, access, pts))
        counter += len(made[-1])
    return b"".join(x.tobytes() for x in made)


@dataclass
class Stream:
    samples: bytes
    timestamps: list[int] = field(default_factory=list)
    #: (place of the first sample, timestamp, packet) of units that decoding can start at
    random_access: list[tuple[int, int, int]] = field(default_factory=list)
    continuity_errors: int = 0
    packets: int = 0


def table_body(row: np.ndarray, table: int) -> bytes:
    raw = row.tobytes()
    at = 5 + raw[4]
    size = struct.unpack_from(">H", raw, at + 1)[0] & 0xFFF
    whole = raw[at : at + 3 + size]
    if whole[0] != table or crc_mpeg(whole):
        raise ValueError("damaged program table")
    return whole[8:-4]


def demux(stream: bytes) -> Stream:
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if not len(rows) or (rows[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begins, control = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3
    tables = {}
    for k in np.flatnonzero(begins & (pid == PAT_PID)):
        body = table_body(rows[k], 0)
        tables |= {p & 0x1FFF: n for n, p in struct.iter_unpack(">HH", body) if n}
    streams = {}
    for k in np.flatnonzero(begins & np.isin(pid, list(tables))):
        body = table_body(rows[k], 2)
        at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
        while at < len(body):
            kind, es, info = struct.unpack_from(">BHH", body, at)
            streams[es & 0x1FFF] = kind
            at += 5 + (info & 0xFFF)
    if not streams:
        raise ValueError("no elementary stream")
    out = Stream(b"", packets=len(rows))
    for p in [PAT_PID, *tables, *streams]:
        counters = rows[(pid == p) & (control & 1 > 0), 3].astype(np.int16) & 15
        out.continuity_errors += int(((np.diff(counters) & 15) != 1).sum())
    mine = np.flatnonzero((pid == min(streams)) & (control & 1 > 0))
    es = rows[mine]
    offset = np.where(control[mine] & 2 > 0, 5 + es[:, 4].astype(np.int32), 4)
    flat = es[np.arange(PACKET) >= offset[:, None]]
    ends = np.cumsum(PACKET - offset)
    indicator = (control[mine] & 2 > 0) & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    heads = np.flatnonzero(begins[mine])
    starts = (ends - (PACKET - offset))[heads]
    data, samples, at, last = flat.tobytes(), [], 0, None
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
        prefix, size, flags, header = struct.unpack_from(">IHHB", data, a)
        if prefix >> 8 != 1 or size != b - a - 6 or not flags & 0x80:
            raise ValueError("damaged unit")
        x, y, z = struct.unpack_from(">BHH", data, a + 9)
        pts = (x & 0x0E) << 29 | (y & 0xFFFE) << 14 | z >> 1
        while last is not None and pts < last:
            pts += WRAP
        last = pts
        out.timestamps.append(pts)
        if indicator[heads[k]]:
            out.random_access.append((at, pts, int(mine[heads[k]])))
        samples.append(data[a + 9 + header : b])
        at += len(samples[-1])
    out.samples = b"".join(samples)
    return out


def payload(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def batches_of(frame: pd.DataFrame, column: str, most: int = 16_000_000) -> Iterator[pd.DataFrame]:
    """Slices of a batch with a bounded sum of sizes, so that long rows don't pile up."""
    total = np.cumsum([len(x) for x in frame[column]])
    for _, part in frame.groupby(total // most, sort=True) if len(frame) else []:
        yield part


def store(documents: DataFrame) -> DataFrame:
    """Media column of every text: doc_id, n_bytes, media. A written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batches_of(batch, "raw"):
                media = [mux(payload(bytes(x))) for x in part["raw"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in part["raw"]], "media": media})

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return common.written(rows.mapInPandas(run, "doc_id long, n_bytes long, media binary"), "media")


PROBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<struct<sample:long,pts:long,packet:long>>"


def probe(media: DataFrame) -> DataFrame:
    """What the stored streams hold: samples' digests, timestamps and random access points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, n, stream in zip(batch["doc_id"].astype("Int64"), batch["n_bytes"], batch["media"], strict=True):
                stream = bytes(stream)
                s = demux(stream)
                feature = f"packets={s.packets};units={len(s.timestamps)};access={len(s.random_access)};last={s.timestamps[-1]};errors={s.continuity_errors}"
                points = [{"sample": a, "pts": p, "packet": k} for a, p, k in s.random_access]
                out.append((doc_id, n, len(s.samples), hashlib.sha256(s.samples).hexdigest(), zlib.crc32(s.samples[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, s.timestamps, points))
            yield pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in "doc_id,n_bytes,payload_bytes,payload_sha256,tail_crc32,media_bytes,media_sha256,feature,timestamps,random_access".split(",")]).astype({"doc_id": "Int64"})

    return media.mapInPandas(run, PROBED)


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe(store(common.documents(spark, sf_dir)))
    points = F.transform("random_access", lambda x: F.concat_ws("@", x["sample"].cast("string"), x["pts"].cast("string")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.array_join(points, ",").alias("access_points"))
