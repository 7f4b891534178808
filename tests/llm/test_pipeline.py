"""The pipeline's stages, each on what the one before kept, and its rows as a whole."""

from __future__ import annotations

from collections import Counter

import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline as P  # noqa: E402

from paperloom.llm import mixing, simhash, toxicity  # noqa: E402

from .test_operators import brute_print, check_packing, labelled  # noqa: E402


def test_stages(spark, odd, sf_of):
    docs, labels = labelled(spark, 400)
    many = odd.limit(0).unionByName(docs, allowMissingColumns=True).unionByName(odd)
    sf = sf_of(documents=many, labels=labels)
    now, toxic = many, {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, sf).persist()
        assert now.columns == before.columns, name
        a, b = (Counter(map(tuple, x.select("doc_id", "text").collect())) for x in (before, now))
        assert set(b) <= set(a)
        if name == "toxicity":
            gone = {k[0] for k in a - b}
            assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 5
        if name == "exact dedup":
            assert Counter(t or "" for _, t in b.elements()) == Counter({t or "" for _, t in a})
            assert all((d is None) or d == max(x for x, u in a if x is not None and (u or "") == (t or "")) for d, t in b)
        if name == "simhash near-dedup":
            assert all(n == 1 for n in b.values())
            prints = [brute_print(t) for _, t in b]
            assert all((x ^ y).bit_count() > 4 for k, x in enumerate(prints) for y in prints[:k])
        if name == "source mixing":
            assert b == Counter(map(tuple, mixing.mix(before).select("doc_id", "text").collect()))
    rows = P.STAGES[-1][1](spark, now, sf).collect()
    check_rows = [r for r in now.select("doc_id", "text").collect()]
    sequences, least = check_packing(rows, check_rows)
    assert sequences <= least + 2


def test_empty_tables(spark, nothing, sf_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = sf_of(documents=nothing, labels=labels)
    now = nothing
    for name, stage in P.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0, name
    assert P.run(spark, sf).count() == 0


def test_run(spark, sf):
    made = P.run(spark, sf)
    assert made.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(made.columns)
    assert P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5


def test_queries_with_sql(spark, sf):
    import duckdb

    from paperloom.llm import queries as Q

    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for name, sql in Q.oracle_sql().items():
        made, expected = Q.queries()[name](spark, sf).toPandas(), db.execute(sql).df()
        names = sorted(expected.columns)
        assert sorted(made.columns) == names
        assert Counter(map(tuple, made[names].values.tolist())) == Counter(map(tuple, expected[names].values.tolist())), name


def test_model_is_the_same_each_time(spark):
    docs, labels = labelled(spark, 200)
    a, b = (toxicity.train(docs.repartition(k), labels) for k in (1, 5))
    assert all((x == y).all() for x, y in zip(a.weights["conv"], b.weights["conv"], strict=True)) and a.thresholds == b.thresholds
    assert simhash.LIMIT == 4
