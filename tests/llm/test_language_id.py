"""The string kernel against sets of strings, the regression against its dual form, and accuracy on held-out rows."""

from __future__ import annotations

import os
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import language_id as L

WIDE = replace(L.Settings(), bits=24)  # so wide that the few n-grams below have hashes of their own


def grams(text):
    """Of the text's letters and marks, lower-cased, with one space for all else and around."""
    text = f" {''.join(c if L.letters()[ord(c)] else ' ' for c in text.lower())} "
    text = f" {' '.join(text.split())} " if text.strip() else " "
    return {text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1)}


TEXTS = ["The cat", "the  CAT!", "Ein Wort, zwei", "übermäßig 12 über", "日本語のテキスト", "a", "\U0001f600 ok \U00010400", "x" * 500, "हिन्दी भाषा"]


def test_sets_are_those_of_strings():
    sets = L.Sets(WIDE)
    names = {}
    for text in TEXTS:
        own = sets.of(text)
        assert len(own) == len(grams(text))
        for other in names:
            assert len(np.intersect1d(own, names[other])) == len(grams(text) & grams(other))
        names[text] = own
    assert not sets.seen.any()


def test_kernel_is_exact():
    sets = L.Sets(WIDE)
    own = [sets.of(t) for t in TEXTS]
    found = L.Kernel(own[:4], WIDE)(own)
    expected = [[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in TEXTS[:4]] for a in TEXTS]
    assert np.allclose(found, expected, atol=1e-12)


def test_all_texts_as_landmarks_give_kernel_ridge_regression():
    """With every training text a landmark, Nyström features are exact and the margins those of the dual form."""
    rng = np.random.default_rng(5)
    words = {"a": "the of and to in is".split(), "b": "der die und das ist ein".split(), "c": "le la les et des un".split()}
    sets = L.Sets(L.Settings())
    sample = [(name, sets.of(" ".join(rng.choice(own, 5)) + f" {rng.integers(9)}" + "zyx"[k % 3] * (k % 7))) for k in range(8) for name, own in words.items()]
    settings = replace(L.Settings(), landmarks=1000, ridge=0.1)
    model = L.fit(sample, settings)
    own, y = [s for _, s in sample], np.array([model.languages.index(n) for n, _ in sample])
    k = np.array([[len(np.intersect1d(a, b)) / (len(a) * len(b)) ** 0.5 for b in own] for a in own]) + 1  # the constant
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    dual = np.linalg.solve(k + 0.1 * np.diag(np.bincount(y)[y].astype(float)), target)
    assert np.allclose(model.margins(own), k @ dual, atol=1e-6)


def test_predictions_do_not_depend_on_batches():
    sets = L.Sets(L.Settings())
    model = L.fit([(t[:1], sets.of(t)) for t in TEXTS], L.Settings())
    texts = [None, "", "123 !?", *TEXTS, "²", "no. 5"]
    names, scores = model.predictor()(texts)
    one_by_one = [model.predictor(batch=1)([t]) for t in texts]
    assert names.tolist() == [n[0] for n, _ in one_by_one] and np.allclose(scores, [s[0] for _, s in one_by_one], atol=1e-12)
    assert names.tolist()[:3] == ["und"] * 3 and scores[:3].tolist() == [0.0] * 3 and names[-2] == "und" and names[-1] != "und"
    assert ((scores >= 0) & (scores <= 1)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = L.op12_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    told = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.98 and len(told) > 150
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in found)


def test_nothing_is_learned_from_the_held_out_fold(spark):
    rows = [(k, f"word{k % 7} alpha beta", "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else "yy") for k in range(200)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["yy"]


def test_sample_is_bounded_and_takes_repeats_once(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.regexp_replace(F.col("id").cast("string"), "(.)", "a$1"))).alias("text"), F.when(F.col("id") % 10 < 8, "aa").otherwise("bb").alias("lang"))
    settings = replace(L.Settings(), texts=100)
    sample = L.training_sample(rows, settings)
    assert {n: sum(x == n for x, _ in sample) for n in ("aa", "bb")} == {"aa": 50, "bb": 50}
    assert sample == sample[:0] + sample and [n for n, _ in L.training_sample(rows.repartition(7), settings)] == [n for n, _ in sample]


def test_odd_tables(spark, odd, nothing, sf_of):
    found = L.op12_language_id(spark, sf_of(documents=odd)).collect()
    assert len(found) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            assert r["lang_pred"] == ("en" if any(c.isalpha() for c in texts[r["doc_id"]] or "") else "und")
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert L.op12_language_id(spark, sf_of(documents=nothing)).collect() == []
    untaught = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in L.op12_language_id(spark, sf_of(documents=untaught)).collect()} == {("und", 0.0)}
    kept = L.identify(odd, L.train(odd))
    assert kept.columns == [*[c for c in odd.columns if c != "score"][:5], "score", *odd.columns[6:], "lang_pred"]
