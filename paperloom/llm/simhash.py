"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits. The embedding is each segment's bit count, kept in unary (00, 01,
11), so that the Manhattan distance of two embeddings is the number of bits in which they differ. It never exceeds the
Hamming distance of the fingerprints, hence filters without loss. The grid: the segments form six groups; within Manhattan
distance 4 at least two groups' counts agree whole, so the 15 cells named by two groups' counts hold every pair between
them. More fingerprints take seven to nine groups, of which three to five agree (35 to 126 cells): a segment's counts are
equal by chance with 3/8, so cells are then as small as before. Inside a cell rows are compared by Manhattan distance, then
exactly, and give a spanning forest rather than all pairs.

Only distinct fingerprints are compared. A worker never holds more than ``block`` rows of a cell; larger cells are compared
in pairs of blocks, exactly as well.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other; equal texts and
repeated rows share a component; texts of any length are hashed whole; a null doc_id gets a component but names none
unless all its members are null; an empty table gives no rows; extra columns are ignored (``keep_one`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import connected
from .encoding import slices

LOW_BITS = 0x5555555555555555
LIMIT = 4
#: Distinct fingerprints up to which so many groups do: by chance a fingerprint has under 100 others in a cell.
GROUPS = {6: 3_000_000, 7: 60_000_000, 8: 600_000_000, 9: 1 << 63}
#: Names of cells above a block that are broadcast at most.
LARGE_CELLS = 200_000


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64 bits; a bit is set where more than half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    found = raw.lower().split()
    if not found:
        return 0
    text = b" ".join(found)
    if len(found) <= words:
        hashes = [xxh64_intdigest(text, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1].tolist()
        hashes = [xxh64_intdigest(text[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), th (hash of the text), in a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "raw"):
                fps = np.array([fingerprint(x, words, seed) for x in some.column("raw").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(fps), some.column("th")], ["doc_id", "fp", "th"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"), F.xxhash64(text).alias("th"))
    return common.written(rows.mapInArrow(run, "doc_id long, fp long, th long"), "fingerprints")


def unary(fp: Column) -> Column:
    """The embedding: each two-bit segment's bit count, in unary."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS)), fp.bitwiseAND(F.lit(LOW_BITS))
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def masks(groups: int = 6) -> list[int]:
    """Bits of all but LIMIT of the groups, each way of choosing them, as signed longs."""
    sizes = [32 // groups + (k < 32 % groups) for k in range(groups)]  # in segments of two bits
    starts = np.cumsum([0, *sizes])
    bits = [((1 << 2 * n) - 1) << 2 * int(at) for n, at in zip(sizes, starts, strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(bits, groups - LIMIT))]


def link(run: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """Label of each row: the first row of its run that it reaches by links. Rows of a run are adjacent."""
    high, low = fp >> np.uint64(1) & np.uint64(LOW_BITS), fp & np.uint64(LOW_BITS)
    u, label, d = high | low | (high & low) << np.uint64(1), np.arange(len(fp)), 1
    live = np.flatnonzero(run[:-1] == run[1:])  # rows with another of their run at distance d
    while len(live):
        other = live + d
        # Manhattan distance of the embeddings bounds the Hamming distance from below
        near = (label[live] != label[other]) & (np.bitwise_count(u[live] ^ u[other]) <= limit)
        i, j = live[near], other[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= limit
        i, j = i[near], j[near]
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(flat := label[label], label):
                label = flat
        d += 1
        live = live[live + d < len(fp)]
        live = live[run[live] == run[live + d]]
        if d % 64 == 0 and len(live):  # runs that are one component already need no more comparisons
            starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            sizes = np.diff(np.append(starts, len(run)))
            done = np.maximum.reduceat(label, starts) == np.minimum.reduceat(label, starts)
            live = live[~np.repeat(done, sizes)[live]]
    return label


def star_edges(cells: DataFrame, keys: list[str], limit: int, block: int) -> DataFrame:
    """(a, b) edges of a spanning forest of each cell's links; a row with null b names a cell above ``block`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the rows of the last cell so far wait for its end; of one that is too large, a row stands for it
        held, large = None, False
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            changes = np.flatnonzero(first_of_run(rows))
            if large:
                second = int(changes[1]) if len(changes) > 1 else len(rows)
                rows, changes = (rows.iloc[second:], changes[1:] - second) if second < len(rows) else (rows.iloc[:1], changes[:1])
                large = second >= len(held) + len(batch)
            cut = int(changes[-1])
            if cut:
                yield from compare(rows.iloc[:cut])
            held = rows.iloc[cut:]
            if not large and len(held) > block:
                yield pd.DataFrame({"a": [held["cell"].iloc[0]], "b": pd.array([None], "Int64"), "proj": [held["proj"].iloc[0]]})
                large = True
            if large:
                held = held.iloc[:1]
        if held is not None and not large:
            yield from compare(held)

    def first_of_run(rows: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(rows), bool)
        change[0] = True
        for k in keys:
            x = rows[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return change

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(first_of_run(rows))
        sizes = np.diff(np.append(starts, len(rows)))
        group = np.repeat(np.arange(len(starts)), sizes)
        fp, proj, cell = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["proj"].to_numpy(), rows["cell"].to_numpy()
        for k in np.flatnonzero(sizes > block):  # cells that began and ended in one batch
            yield pd.DataFrame({"a": [cell[starts[k]]], "b": pd.array([None], "Int64"), "proj": [proj[starts[k]]]})
        small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
        parts = [np.flatnonzero(small)] + [np.arange(starts[k], starts[k] + sizes[k]) for k in np.flatnonzero((sizes > 64) & (sizes <= block))]
        for part in parts:
            if len(part):
                f = fp[part]
                label = link(group[part], f, limit)
                moved = np.flatnonzero(label != np.arange(len(f)))
                signed = f.view(np.int64)
                yield pd.DataFrame({"a": signed[moved], "b": pd.array(signed[label[moved]], "Int64"), "proj": np.full(len(moved), -1)})

    dealt = cells.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInPandas(run, "a long, b long, proj int")


def grid(classes: DataFrame, groups: int) -> DataFrame:
    """fp, proj, cell: the cells of each fingerprint (column fp), named by the counts of all but LIMIT groups."""
    u = unary(F.col("fp"))
    return classes.select("fp", F.posexplode(F.array(*[u.bitwiseAND(F.lit(m)) for m in masks(groups)])).alias("proj", "cell"))


def edges(classes: DataFrame, limit: int = LIMIT, block: int = 1 << 15, groups: int | None = None) -> DataFrame:
    """Edges between distinct fingerprints (column fp) whose components are those of all pairs within ``limit`` bits."""
    if limit > LIMIT:
        raise ValueError(f"the grid is complete up to {LIMIT} bits")
    if groups is None:
        n = classes.count()
        groups = next(g for g, most in GROUPS.items() if n <= most)
    keys = ["proj", "cell"]
    cells = grid(classes, groups)
    found = common.written(star_edges(cells, keys, limit, block), "links")
    large = found.where("b IS NULL").select("proj", F.col("a").alias("cell")).distinct()
    pairs = found.where("b IS NOT NULL").select("a", "b")
    if large.isEmpty():
        return pairs
    few = large.count() <= LARGE_CELLS
    inside = common.written(cells.join(F.broadcast(large) if few else large, keys), "large-cells")
    sizes = inside.groupBy(*keys).agg(F.ceil(2 * F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = inside.join(sizes, keys).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("fp", *keys, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    more = common.written(star_edges(dealt, [*keys, "i", "j"], limit, 1 << 62), "large-links")
    return pairs.unionByName(more.select("a", "b"))


def classify(documents: DataFrame, words: int = 4, limit: int = LIMIT, block: int = 1 << 15, similar: float | None = None) -> DataFrame:
    """doc_id, fp, th, component_id: the least doc_id that is reachable over links of at most ``limit`` bits.

    With ``similar`` also over links between texts of at least that similarity of five-word shingles.
    """
    prints = fingerprints(documents, words)
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    links = edges(classes, limit, block)
    if similar is None:
        roots = connected(links)
    else:
        found = shingles.Candidates(documents, lambda raw: fingerprint(raw, words), similar)
        # most similar texts meet over their cells' representatives; what these don't join is compared whole
        first = connected(links.unionByName(found.represented()))
        second = connected(found.remaining(first))
        hot = common.hot_keys(first.groupBy("b").agg(F.count("*").alias("n")), "b", "n", first.count(), 200)
        moved = common.join_one(first, second.select(F.col("a").alias("b"), F.col("b").alias("far")), "b", hot, "a")
        # the second's nodes are roots of the first, hence no leaves there
        roots = moved.select("a", F.coalesce("far", "b").alias("b")).unionByName(second)
    rooted = common.written(classes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    total = prints.count()
    many = linked.where("members > 1")
    found = common.join_one(rooted, many, "root", common.hot_keys(many, "root", "members", total, 200), "fp")
    named = found.select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return common.join_one(prints, named.drop("n"), "fp", common.hot_keys(classes, "fp", "n", total, 200), "doc_id")


def keep_one(documents: DataFrame, similar: float | None = None) -> DataFrame:
    """Of each component the row with the least doc_id (of several, the one with the least text hash), whole."""
    none = F.lit(-(1 << 63))
    found = classify(documents, similar=similar).select(F.coalesce("doc_id", none).alias("_pl_id"), F.col("th").alias("_pl_th"), F.coalesce("component_id", none).alias("_pl_of"))
    # rows without any id in their component: one stays for each text
    nameless = F.when(F.col("_pl_id") == none, F.col("_pl_th"))
    reps = found.where("_pl_id = _pl_of").groupBy("_pl_id", nameless.alias("_pl_own")).agg(F.min("_pl_th").alias("_pl_th"))
    keyed = documents.withColumns({"_pl_id": F.coalesce(F.col("doc_id").cast("long"), none), "_pl_th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return common.semi_once(keyed, reps, ["_pl_id", "_pl_th"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
