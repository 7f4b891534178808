"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band of minimum hashes: 32 bands of four, so that a pair at 0.8 meets in none of them with a
probability of 5 in 10^8, and a pair above it more rarely. Candidates are compared by their whole sets of shingles (XXH64
of each), so no link is an estimate. Copies that were made from one text differ more from each other than from it: a cell's
texts are first compared with the one that has most company, then only components that this leaves apart are compared.

Words are those of the fingerprints: lower case in ASCII, cut at ASCII white space; a text of up to five words is one
shingle. Null and empty texts have no shingles, hence no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import slices

WORDS, AT_LEAST = 5, 0.8
BANDS, ROWS = 32, 4
#: Rows of a cell that one task joins to the cell's representative.
CELL_ROWS = 1000
_RANDOM = np.random.default_rng(42)
ADD, TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(odd) for odd in (0, 1))
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes."""
    from xxhash import xxh64_intdigest

    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    text = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(text)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(text[a:b]) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number a band, as signed longs; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024, None] ^ ADD) * TIMES).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def between(sets: list[np.ndarray], groups: np.ndarray, at_least: float = AT_LEAST) -> list[tuple[int, int]]:
    """Pairs of groups with similar sets, none empty: all pairs of sets of different groups are compared."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    names, of, counts = np.unique(groups, return_inverse=True, return_counts=True)
    # small groups first, each against all later ones: the rows of the largest are only compared with
    order = np.lexsort((of, counts[of]))
    sizes = np.array([len(s) for s in sets])
    pieces = np.split(flat, np.cumsum(sizes)[:-1])
    of, sizes = of[order], sizes[order]
    flat = np.concatenate([pieces[k] for k in order])
    starts, links, mark = np.cumsum(sizes) - sizes, set(), np.zeros(len(values), bool)
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1  # where each group ends
    later = ends[np.searchsorted(ends, np.arange(len(of)), "right")]
    for k in range(len(of)):
        n = later[k]
        if n == len(of):
            break
        own = flat[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        both = np.add.reduceat(mark[flat[starts[n] :]], starts[n:] - starts[n], dtype=np.int64)
        mark[own] = False
        near = both / (sizes[k] + sizes[n:] - both) >= at_least
        links.update((names[of[k]], names[x]) for x in np.unique(of[n:][near]))
    return sorted(links)


class Candidates:
    """Texts that share a band. ``label`` names a text by a signed 64-bit number, as nodes of the links are named.

    ``represented`` compares each text with the representative of each of its cells (the text with most company in all its
    cells), which is linear in the cells' sizes; ``remaining`` then compares, in cells that still hold several components,
    all pairs between components. Cells of many bytes are compared in pairs of blocks.
    """

    def __init__(self, documents: DataFrame, label: Callable[[bytes], int], at_least: float = AT_LEAST, block_bytes: int = 1 << 24):
        self.at_least, self.block_bytes = at_least, block_bytes
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = documents.select(text.cast("binary").alias("raw"), F.xxhash64(text).alias("th"))

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, "raw"):
                    made = [bands(shingles(x)) for x in some.column("raw").to_pylist()]
                    yield pa.RecordBatch.from_arrays([some.column("th"), pa.array(made, pa.list_(pa.int64()))], ["th", "cells"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, "raw"):
                    raw = some.column("raw").to_pylist()
                    names = np.array([label(x) for x in raw], np.uint64).view(np.int64)
                    made = pa.array([shingles(x).view(np.int64) for x in raw], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column("th"), pa.array(names), made], ["th", "name", "hashes"])

        sketches = common.written(rows.mapInArrow(sketch, "th long, cells array<long>"), "sketches").dropDuplicates(["th"])
        cells = sketches.select("th", F.explode("cells").alias("cell"))
        sizes = common.written(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell-sizes")
        hot = common.hot_keys(sizes, "cell", "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 200)
        #: th, cell, n: the cells of several texts
        self.cells = common.written(common.join_one(cells, sizes, "cell", hot, "th", "inner"), "cells")
        wanted = rows.join(self.cells.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"]).select("raw", "th")
        #: th, name, hashes: the whole sets of these texts
        self.sets = common.written(wanted.mapInArrow(whole, "th long, name long, hashes array<long>"), "shingle-sets")

    def represented(self) -> DataFrame:
        """(a, b): names of texts similar to a representative, and its name."""
        company = self.cells.groupBy("th").agg(F.sum("n").alias("company"))
        ranked = self.cells.join(company, "th")
        heads = ranked.groupBy("cell", "n").agg(F.max(F.struct("company", "th")).alias("_head")).select("cell", "n", F.col("_head.th").alias("head"))
        dealt = self.cells.withColumn("_s", common.by_size(F.col("n"), F.col("th"), CELL_ROWS))
        pairs = dealt.join(heads.withColumn("_s", F.explode(common.all_by_size(F.col("n"), CELL_ROWS))).drop("n"), ["cell", "_s"]).where("th <> head").select("th", "head").distinct()
        mine = common.written(pairs.join(self.sets, "th"), "represented")
        hot = common.hot_keys(mine.groupBy("head").agg(F.count("*").alias("n")), "head", "n", mine.count(), 200)
        heads = self.sets.select(F.col("th").alias("head"), F.col("name").alias("b"), F.col("hashes").alias("_of"))
        heads = heads.join(mine.select("head").distinct(), "head", "left_semi")
        both = common.join_one(mine, heads, "head", hot, "th", "inner")
        shared = F.size(F.array_intersect("hashes", "_of"))
        similar = shared / (F.size("hashes") + F.size("_of") - shared) >= self.at_least
        return common.written(both.where(similar & (F.col("name") != F.col("b"))).select(F.col("name").alias("a"), "b").distinct(), "similar")

    def remaining(self, roots: DataFrame) -> DataFrame:
        """(a, b): components, named by their roots, of similar texts. ``roots`` has a root b for each name a that isn't one."""
        named = self.sets.select("th", F.col("name").alias("a"), (8 * F.size("hashes") + 64).cast("long").alias("bytes"))
        rooted = named.join(roots, "a", "left").select("th", F.coalesce("b", "a").alias("root"), "bytes")
        placed = common.written(self.cells.join(rooted, "th"), "placed")
        mixed = placed.groupBy("cell").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.sum("bytes").alias("_all")).where("_a <> _b")
        mixed = mixed.select("cell", F.ceil(2 * F.col("_all") / self.block_bytes).cast("int").alias("_blocks"))
        blocks = F.when(F.col("_blocks") > 2, F.col("_blocks")).otherwise(1)
        hot = common.hot_keys(self.cells.groupBy("cell").agg(F.count("*").alias("n")), "cell", "n", placed.count(), 200)
        dealt = common.join_one(placed, mixed.select("cell", blocks.alias("blocks")), "cell", hot, "th", "inner").withColumn("mine", F.pmod(F.xxhash64("th", "cell"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("th", "cell", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        at_least, keys = self.at_least, ["cell", "i", "j"]

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def links() -> pd.DataFrame:
                found = between(sets, np.array(names), at_least) if len(set(names)) > 1 else []
                return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

            now, names, sets, out = None, [], [], []
            for batch in batches:
                for *key, name, hashes in batch[[*keys, "root", "hashes"]].itertuples(index=False):
                    if key != now:
                        out.append(links())
                        now, names, sets = key, [], []
                    names.append(name)
                    sets.append(hashes)
                yield pd.concat(out) if out else links().iloc[:0]
                out = []
            yield links()

        made = dealt.join(self.sets.select("th", "hashes"), "th").select(*keys, "root", "hashes").repartition(*keys).sortWithinPartitions(*keys)
        return common.written(made.mapInPandas(compare, "a long, b long").distinct(), "remaining")
