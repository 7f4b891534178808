"""Top-k by blocks against a full scan, with ties, and what it leaves unread."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import inverted_index as I
from paperloom.operators import search as X
from paperloom.sources.storage import fresh_path


@pytest.fixture(scope="module")
def corpus(spark):
    """Zipf-like words, many equal documents, nulls and empty texts, a rare word in few long documents."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for k in range(3000)]
    rows += [(5000 + k, "tie w250 tie") for k in range(40)] + [(6000, None), (6001, ""), (6002, "rare " + "w0 " * 500), (6003, "rare"), (6003, "rare")]
    return spark.createDataFrame(rows, "doc long, text string").repartition(4)


def plain(rows, words, k):
    split = [(d, [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]) for d, t in rows]
    mean = sum(len(w) for _, w in split) / len(split)
    words = list(dict.fromkeys(words))
    df = {q: sum(q in w for _, w in split) for q in words}
    found = []
    for d, w in split:
        if any(q in w for q in words):
            score = 0.0
            for q in words:
                tf = float(w.count(q))
                if tf:
                    score += math.log((len(split) - df[q] + 0.5) / (df[q] + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / mean)))
            found.append((d, score))
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


QUERIES = {1: ["w0"], 2: ["w0", "w250"], 3: ["tie"], 4: ["rare", "w0", "w1", "rare"], 5: ["absent"], 6: ["absent", "w299", "w7"], 7: [], 8: ["w1", "w2", "w3", "w4", "w5"]}


@pytest.mark.parametrize(("k", "size"), [(1, 128), (10, 16), (50, 128)])
def test_top_is_that_of_a_full_scan(spark, corpus, k, size):
    index = I.build(corpus, "doc", fresh_path(spark, "index"), size=size)
    queries = spark.createDataFrame(list(QUERIES.items()), "query int, words array<string>")
    rows = [tuple(r) for r in corpus.collect()]
    found = {}
    for r in index.top(queries, k).orderBy("query", "place").collect():
        found.setdefault(r["query"], []).append((r["doc"], r["score"]))
    for q, words in QUERIES.items():
        expected = plain(rows, words, k)
        assert [d for d, _ in found.get(q, [])] == [d for d, _ in expected], q
        assert [s for _, s in found.get(q, [])] == pytest.approx([s for _, s in expected])
    # fewer blocks are read than hold the words
    held = {r["query"]: r["n"] for r in index.bounds(queries).groupBy("query").agg(F.count("*").alias("n")).collect()}
    read = {r["query"]: r["n"] for r in index.plan(queries, k).groupBy("query").agg(F.sum("blocks").alias("n")).collect()}
    assert all(read[q] <= held[q] for q in held) and sum(read.values()) < sum(held.values())
    if k == 1:  # the rare word's documents are above all that hold only the frequent ones
        assert read[4] < held[4] / 2


def test_scores_are_those_of_the_scan(spark, corpus):
    index = I.build(corpus, "doc", fresh_path(spark, "index"))
    queries = spark.createDataFrame([(1, ["w3", "w40"])], "query int, words array<string>")
    found = {r["doc"]: r["score"] for r in index.top(queries, 10_000).collect()}
    assert found == pytest.approx({r["doc"]: r["score"] for r in X.bm25(corpus.where("doc < 6003"), "doc", ["w3", "w40"]).collect()}, rel=0.01)


def test_bounds_do_not_read_postings(spark, corpus):
    index = I.build(corpus, "doc", fresh_path(spark, "index"))
    queries = spark.createDataFrame([(1, ["w0"])], "query int, words array<string>")
    plan = index.ranges(queries)._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "impact" not in plan


def test_empty_index(spark, corpus):
    index = I.build(corpus.limit(0), "doc", fresh_path(spark, "index"))
    assert index.docs == 0 and index.top(spark.createDataFrame([(1, ["w0"])], "query int, words array<string>")).count() == 0


def shuffled(spark, run):
    """run() and the rows that it shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen = {s.stageId() for s in stages(store)}
    made = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return made, sum(s.shuffleWriteRecords() for s in stages(store) if s.stageId() not in seen)


def stages(store):
    found = store.stageList(None, *[getattr(store, f"stageList$default${n}")() for n in range(2, 6)])
    return [found.apply(k) for k in range(found.size())]


def test_neither_texts_nor_postings_are_shuffled(spark, corpus):
    rows = spark.createDataFrame(corpus.collect(), corpus.schema).coalesce(4)
    index, n = shuffled(spark, lambda: I.build(rows, "doc", fresh_path(spark, "index")))
    blocks = index.table("blocks")
    words, postings = blocks.select("word").distinct().count(), blocks.agg(F.sum("n")).first()[0]
    assert n <= 4 * words + 10 < index.docs < postings / 10  # words with their counts, a task
    queries = spark.createDataFrame([(1, ["w250", "rare"])], "query int, words array<string>")
    found, n = shuffled(spark, lambda: index.top(queries, 3).collect())
    assert len(found) == 3 and n < blocks.count() / 2


def test_a_range_in_several_batches_and_tasks(spark, corpus):
    """Batches that end within a range give the same blocks; blocks of a range that two tasks read are added up."""
    index = I.build(corpus, "doc", fresh_path(spark, "index"), size=16)
    rows = index.table("documents").where("length > 0").orderBy("at").select("at", "words", "length").toArrow()
    made = [[r for b in I.layout(16, index.mean)(iter(rows.to_batches(n))) for r in b.to_pylist()] for n in (7, 10_000)]
    assert made[0] == made[1] and len(made[0]) == index.table("blocks").count()
    halves = [r for part in (rows.slice(0, 1005), rows.slice(1005)) for b in I.layout(16, index.mean)(iter(part.to_batches())) for r in b.to_pylist()]
    assert len(halves) > len(made[0])
    other = I.SearchIndex(spark, fresh_path(spark, "index"), index.docs, index.mean, 16)
    spark.createDataFrame(halves, index.table("blocks").schema).write.parquet(f"{other.path}/blocks")
    for name in ("documents", "words"):
        index.table(name).write.parquet(f"{other.path}/{name}")
    queries = spark.createDataFrame(list(QUERIES.items()), "query int, words array<string>")
    assert sorted(other.top(queries, 10).collect()) == sorted(index.top(queries, 10).collect())


def test_many_queries_in_lots(spark, corpus, monkeypatch):
    """Queries in several lots, and nothing broadcast."""
    index = I.build(corpus, "doc", fresh_path(spark, "index"), size=16)
    queries = spark.createDataFrame(list(QUERIES.items()), "query int, words array<string>")
    expected = sorted(index.top(queries, 10).collect())
    monkeypatch.setattr(I, "AT_A_TIME", 2)
    monkeypatch.setattr(I, "BROADCAST_ROWS", 3)
    assert expected and sorted(index.top(queries, 10).collect()) == expected
