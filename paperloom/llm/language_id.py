"""Language identification by a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of character n-grams that it holds (presence, not counts, in a blended spectrum of n = 1, 2, 3), with case
folded and each stretch of anything but letters as one space. The kernel of two texts is the size of their sets' common part
over the square root of the product of their sizes. Training texts of each language are drawn in the order of a hash, some
of them are the landmarks; the kernel against these, turned by the inverse root of the landmarks' own kernel matrix, gives
each text's Nyström features, and a ridge regression for each language against the rest is solved in closed form.

Scoring builds a batch's presence matrix over the n-grams that landmarks hold and multiplies it with the landmarks' matrix:
common parts are whole numbers below 2**24, so exact in float32. n-grams are named by ``bits``-bit hashes of their letters.

The sample is bounded (``Settings.texts`` in all, each of at most ``max_chars``, which bounds fitting alone): its sets of
n-grams are made by tasks, and the driver gets these. All else covers whole texts and all rows.

Defined cases: a text that is null or has no letter is "und" with score 0.0, as is any text if nothing can be learned; a
learned language's rows with null text or without letters don't train; equal texts of one language train once; ties go to the
language that sorts first; a language with no text of up to ``max_chars`` and languages beyond the ``languages`` most
frequent aren't learned; if only one is learned, all texts with a letter have it, with score 1.0; a null doc_id is not held
out and doesn't train; repeated rows get equal results; an empty table gives no rows; extra columns stay (``identify``).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
SPACE = 32
#: Mixes an n-gram's code, which is exact in 63 bits for three code points, before its top bits are taken.
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``texts`` and ``landmarks`` are in all, shared evenly by the languages (one of each at least)."""

    texts: int = 2400
    landmarks: int = 128
    languages: int = 300
    max_chars: int = 50_000
    spectrum: int = 3
    bits: int = 18
    ridge: float = 1e-3
    sharpness: float = 4.0
    seed: int = 11


@functools.cache
def letters() -> np.ndarray:
    """By code point: whether it's a letter or a mark on one."""
    return np.array([unicodedata.category(chr(k))[0] in "LM" for k in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def points(text: str) -> np.ndarray:
    """Code points of the text's letters, lower-cased, with one space around and between their stretches."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, SPACE).astype(np.uint64)
    return code[np.append(True, (code[1:] != SPACE) | (code[:-1] != SPACE))]


class Sets:
    """``of(text)``: the sorted hashed n-grams of a text. Works in one table of marks, whatever the text's length."""

    def __init__(self, settings: Settings):
        self.settings, self.seen = settings, np.zeros(1 << settings.bits, bool)

    def of(self, text: str) -> np.ndarray:
        code = points(text)
        shift, gram = np.uint64(64 - self.settings.bits), code
        for n in range(1, self.settings.spectrum + 1):
            if n > 1:
                if len(gram) < 2:
                    break
                gram = gram[:-1] << np.uint64(21) | code[n - 1 :]
            self.seen[((gram + np.uint64(n << 62 & (1 << 64) - 1)) * MIX >> shift).astype(np.int64)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


class Kernel:
    """The kernel against landmarks, a batch at a time."""

    def __init__(self, landmarks: list[np.ndarray], settings: Settings):
        self.grams = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, np.int64)
        self.place = np.full(1 << settings.bits, -1, np.int32)
        self.place[self.grams] = np.arange(len(self.grams))
        self.sizes = np.array([len(x) for x in landmarks], np.float64)
        self.side = self.presence(landmarks).T.copy()

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        """[texts, n-grams of landmarks] of 0 and 1."""
        out = np.zeros((len(sets), len(self.grams)), np.float32)
        for row, own in zip(out, sets, strict=True):
            at = self.place[own]
            row[at[at >= 0]] = 1
        return out

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        common_part = self.presence(sets) @ self.side
        return common_part / np.sqrt(np.outer([max(len(x), 1) for x in sets], self.sizes))


@dataclass(frozen=True)
class Model:
    """``weights`` [landmarks + 1, languages]: of the kernel and of a constant."""

    settings: Settings
    languages: list[str]
    kernel: Kernel | None
    weights: np.ndarray

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights[:-1] + self.weights[-1]

    def predictor(self, batch: int = 64):
        """texts -> (languages, scores)."""
        sets = Sets(self.settings)

        def predict(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
            for at in range(0, len(known), batch):
                some = known[at : at + batch]
                f = self.settings.sharpness * self.margins([sets.of(texts[k]) for k in some])
                f = np.exp(f - f.max(axis=1, keepdims=True))
                names[some] = np.array(self.languages, object)[f.argmax(axis=1)]
                scores[some] = f.max(axis=1) / f.sum(axis=1)
            return names, scores

        return predict


def fit(sample: list[tuple[str, np.ndarray]], settings: Settings) -> Model:
    """``sample``: (language, set of n-grams) in an order of no meaning; the first of each language are landmarks."""
    languages = sorted({name for name, _ in sample})
    if not languages:
        return Model(settings, [], None, np.zeros((0, 0)))
    y = np.array([languages.index(name) for name, _ in sample])
    sets = [own for _, own in sample]
    share = max(1, settings.landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(y == k)[:share] for k in range(len(languages))])
    kernel = Kernel([sets[k] for k in chosen], settings)
    k_all = np.concatenate([kernel(sets[at : at + 256]) for at in range(0, len(sets), 256)])
    values, vectors = np.linalg.eigh(k_all[chosen])
    live = values > 1e-10 * values.max()
    turn = vectors[:, live] / np.sqrt(values[live])  # the inverse root of the landmarks' kernel matrix
    features = np.concatenate([k_all @ turn, np.ones((len(sets), 1))], axis=1)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y]  # each language counts alike
    left = (features * weight[:, None]).T @ features + settings.ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(left, (features * weight[:, None]).T @ target)
    return Model(settings, languages, kernel, np.concatenate([turn @ solved[:-1], solved[-1:]]))


def held_out(doc_id):
    """The fold that never trains: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(documents: DataFrame, settings: Settings) -> list[tuple[str, np.ndarray]]:
    """Bounded: the first texts of each language in the order of a hash of the text, as sets of n-grams.

    Languages are counted by a plain aggregation. Only texts whose hash is so low that a few times as many as are wanted
    have a lower one are ranked, so that no task gets a whole language; of repeated texts one is kept where they lie.
    """
    usable = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.where(F.col("text").rlike(r"\p{L}") & (F.length("text") <= settings.max_chars))
    rows = usable.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.lit(settings.seed), "text").alias("_order"))
    found = rows.groupBy("lang").agg(F.count("*").alias("_n"), F.approx_count_distinct("_order").alias("_texts"))
    top = found.orderBy(F.desc("_n"), "lang").limit(settings.languages).collect()
    if not top:
        return []
    share = max(1, settings.texts // len(top))
    highest = [(r["lang"], min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, (3 * share + 50) / max(r["_texts"], 1))))) for r in top]
    limits = rows.sparkSession.createDataFrame(highest, "lang string, _most long")
    low = rows.select("lang", "_order").join(F.broadcast(limits), "lang").where("_order <= _most").select("lang", "_order").distinct()
    ranked = low.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order"))).where(F.col("_rank") <= share)
    texts = rows.join(F.broadcast(ranked.drop("_rank")), ["lang", "_order"], "left_semi").groupBy("lang", "_order").agg(F.min("text").alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(settings)
        for batch in stream:
            own = pa.array([sets.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_order"), own], ["lang", "_order", "grams"])

    made = texts.mapInArrow(run, "lang string, _order long, grams array<int>").collect()
    return [(r["lang"], np.array(r["grams"], np.int64)) for r in sorted(made, key=lambda r: (r["_order"], r["lang"]))]


def train(documents: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """From doc_id, text and lang of the rows outside the held-out fold."""
    return fit(training_sample(documents, settings), settings)


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of documents plus lang_pred and score, from the text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = shared.value.predictor()
        for texts in series:
            names, scores = predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = documents.withColumn("_pl_found", run(F.coalesce(F.col(text), F.lit(""))))
    return found.withColumns({"lang_pred": F.col("_pl_found.lang_pred"), "score": F.col("_pl_found.score")}).drop("_pl_found")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
