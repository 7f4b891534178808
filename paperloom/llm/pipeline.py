"""From raw documents to packed training sequences, in stages that each write what they keep.

Every stage takes a table with doc_id, text and source, keeps all other columns whatever their names, and treats a null text
as an empty one. An empty table passes through all stages as one; repeated rows and ties are decided as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, exact_dedup, mixing, packing, shingles, simhash, toxicity
from .encoding import FEW


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows, doesn't reject.

    Equal texts get equal scores, so repeated rows stay or go together; rows without doc_id or text are scored like others.
    Without labels of both classes a row stays if under half of the labels are toxic.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_pl_score").where("_pl_score < 0.5").drop("_pl_score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the largest doc_id, as in op8.

    A row without doc_id stays only if its text has no other; of rows that share text and doc_id one stays.
    """
    return exact_dedup.keep_first(docs, keep="max")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: texts within op10's 4 bits, or with 0.8 of their five-word shingles in common.

    The least doc_id stays; of a component without any, one row of each text. Texts without words are one component.
    """
    return simhash.keep_one(docs, similar=shingles.AT_LEAST)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, globally shuffled. A null source is a source of its own."""
    return mixing.mix(docs).drop("_pl_copy", "_pl_order")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in training sequences. A text without tokens is a piece of the end id."""
    return packing.best_fit(docs, cached=FEW)  # workers have held other stages' memory before


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: A trained classifier, XXH64 fingerprints and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage has written goes when the next one has."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old is not None:
            common.discard(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
