"""Whitening and vector codes against plain whole-number arithmetic."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import vector_codes as V
from paperloom.llm import whitening as W
from paperloom.llm.vectors import matrix

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, n string, _key string"
NAN, INF = float("nan"), float("inf")


def rows_of(vectors, labels=None):
    return [(k, v, labels[k] if labels else k % 3, "x", "y", "z", "w") for k, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls in every column, entries that don't count, other lengths, ties, repeated rows, clashing names, negative floors."""
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(0, 0.2, 32)] for _ in range(90)]
    vectors += [None, [], [1.0] * 31, [NAN] * 32, [INF] + [0.0] * 31, [None] + [0.5] * 31, [-0.001] * 32, [-0.001] * 32]
    rows = rows_of(vectors, [None if k % 5 == 0 else k % 3 for k in range(len(vectors))])
    rows += [rows[4], rows[4], rows[7], (None, vectors[9], 1, None, None, None, None), (None, None, None, None, None, None, None), (11, vectors[12], 2, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def good(rows):
    return [r for r in rows if r["embedding"] is not None and len(r["embedding"]) == 32 and all(x is not None and math.isfinite(x) for x in r["embedding"])]


def test_matrix_of_sliced_and_null_lists():
    lists = pa.array([[9.0, 9.0], None, [1.0, 2.0], [1.0, None], [3.0, NAN], [], [4.0], [5.0, 6.0]]).slice(1)
    at, x = matrix(lists, 2)
    assert at.tolist() == [1, 6] and x.tolist() == [[1.0, 2.0], [5.0, 6.0]]


@pytest.mark.parametrize("size", [3, 200, 1 << 15, 1 << 16, 1 << 31, 1 << 40])
def test_limbs_and_products_are_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (500, 5), endpoint=True)
    x[0], x[1] = size, -size
    assert (sum(p.astype(np.int64) << W.LIMB * k for k, p in enumerate(W.limbs(x))) == x).all()
    moments = W.Moments(5)
    for part in np.array_split(x, 7):
        moments.add(part)
    big = x.astype(object)
    expected = big.T @ big
    found = moments.recombine()
    assert (found == expected).all()
    assert all(sum(d << W.DIGIT * k for k, d in enumerate(W.digits(int(v)))) == v for v in found.reshape(-1))


def test_products_are_recombined_on_the_way(monkeypatch):
    monkeypatch.setattr(W, "RECOMBINE", 10)
    x = np.random.default_rng(0).integers(-(1 << 30), 1 << 30, (100, 3))
    moments = W.Moments(3)
    for part in np.array_split(x, 9):
        moments.add(part)
    assert (moments.recombine() == x.astype(object).T @ x.astype(object)).all()


def test_whitening_against_fractions(spark, odd_vectors, sf_of):
    kept = good(odd_vectors.collect())
    x = [[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in kept]
    n, dim = len(x), 32
    sums = [sum(v[k] for v in x) for k in range(dim)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n) for j in range(dim)] for i in range(dim)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    found = W.op11_whitening(spark, sf_of(embeddings=odd_vectors)).collect()
    assert len(found) == n * 32 and {r["component"] for r in found} == set(range(1, 33)) and {r["n"] for r in found} == {n}
    deviations = sorted(sum((n * v[k] - sums[k]) ** 2 for k in range(dim)) for v in x)
    assert sorted(r["deviation"] for r in found if r["component"] == 1) == deviations
    for k in range(32):
        told = {r["explained"] for r in found if r["component"] == k + 1}
        assert len(told) == 1 and told.pop() == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert {r["identity_error"] for r in found}.pop() < 1e-9
    # the whitened values themselves have no mean and unit covariance, and turned back they are the vectors
    z = {}
    for r in found:
        if r["vec_id"] is not None:
            z.setdefault(r["vec_id"], {}).setdefault(r["component"], set()).add(round(r["whitened"], 9))
    by_id = {r["vec_id"]: v for r, v in zip(kept, x, strict=True)}
    some = [i for i in z if i != 11 and i is not None]  # 11 has two vectors
    side = np.array([[z[i][c + 1].copy().pop() for c in range(32)] for i in some])
    centred = np.array([[float(v - m) for v, m in zip(by_id[i], mean, strict=True)] for i in some])
    assert np.allclose(side @ side.T, centred @ np.linalg.inv(cov) @ centred.T, atol=1e-5)


def test_whitening_without_variance(spark, sf_of):
    flat = spark.createDataFrame(rows_of([[0.5, 0.1, 0.0], [0.5, 0.1, 1.0], [0.5, 0.1, 2.0]]), SCHEMA)
    found = W.op11_whitening(spark, sf_of(embeddings=flat)).collect()
    assert len(found) == 9 and all((r["whitened"] is None) == (r["component"] > 1) for r in found)
    assert {r["explained"] for r in found if r["component"] > 1} == {0.0} and {r["identity_error"] for r in found}.pop() < 1e-9
    one = W.op11_whitening(spark, sf_of(embeddings=spark.createDataFrame(rows_of([[0.5, 0.25]]), SCHEMA))).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(None, 0.0, 0, 0.0)] * 2


def test_deviation_beyond_a_long():
    model = W.Whitening(2, 64, 0, 1 << 20, [3, 5], np.eye(2), np.array([True, True]), np.ones(2))
    y, rest, _ = model.centred(np.array([[1, 2], [1 << 10, 7], [1 << 39, 0], [3, 4]]))
    exact = [sum((model.n * int(v) - int(s)) ** 2 for v, s in zip(row, rest, strict=True)) for row in y]
    assert model.deviation(y, rest).to_pylist() == [e if e < 1 << 63 else None for e in exact]
    assert exact[1] < 1 << 63 < exact[2]


@pytest.mark.parametrize("seed", range(6))
def test_nearest_is_the_full_search(seed):
    rng = np.random.default_rng(seed)
    width, entries, most = rng.integers(1, 9), rng.integers(1, 70), [2, 5, 300][seed % 3]
    x, book = rng.integers(-most, most, (400, width)), rng.integers(-most, most, (entries, width))
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    for block in (1, 16, 100):
        index, best = V.nearest(x, book, block)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def plain_codes(rows, parts, entries, rounds):
    """One part after another, by loops."""
    rows = [(r["vec_id"], r["label"], [math.floor(256 * c) for c in r["embedding"]]) for r in rows]
    width = len(rows[0][2]) // parts
    cut = [[q[k * width : (k + 1) * width] for k in range(parts)] for _, _, q in rows]
    first = {}
    for i, _, q in rows:
        if i is not None:
            first[i] = min(first.get(i, q), q)
    books = [[first[i][k * width : (k + 1) * width] for i in sorted(first)[:entries]] for k in range(parts)]
    distance = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    choose = lambda p, book: min((distance(p, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            taken = [choose(c[k], books[k])[1] for c in cut]
            for e in range(len(books[k])):
                own = [c[k] for c, t in zip(cut, taken, strict=True) if t == e]
                if own:
                    books[k][e] = [math.floor(Fraction(sum(v), len(own))) for v in zip(*own, strict=True)]
    found = [[choose(c[k], books[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, label, _), f, err in zip(rows, found, errors, strict=True)]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_codes_against_loops(spark, odd_vectors, sf_of, monkeypatch, broadcast):
    monkeypatch.setattr(V, "BROADCAST_LABELS", broadcast)
    found = V.op13_vector_codes(spark, sf_of(embeddings=odd_vectors))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_codes(good(odd_vectors.collect()), 16, 64, 2), key=key)


def test_codes_of_few_and_odd_lengths(spark, sf_of):
    few = spark.createDataFrame(rows_of([[0.1 * k] * 5 for k in range(3)]), SCHEMA)
    found = V.op13_vector_codes(spark, sf_of(embeddings=few)).collect()
    assert {(r["vec_id"], r["error"]) for r in found} == {(0, 0), (1, 0), (2, 0)}
    assert {r["code"][:10] for r in found} == {"0000000000", "0101010101", "0202020202"} and {len(r["code"]) for r in found} == {32}
    nameless = spark.createDataFrame([(None, [0.5] * 16, 1, None, None, None, None)] * 2, SCHEMA)
    assert [(r["code"], r["error"], r["label_error"]) for r in V.op13_vector_codes(spark, sf_of(embeddings=nameless)).collect()] == [(None, None, None)] * 2


def test_empty_tables(spark, sf_of):
    for rows in ([], [(1, None, 1, None, None, None, None), (2, [], 1, None, None, None, None), (3, [NAN], 1, None, None, None, None)]):
        sf = sf_of(embeddings=spark.createDataFrame(rows, SCHEMA))
        assert W.op11_whitening(spark, sf).collect() == [] and V.op13_vector_codes(spark, sf).collect() == []
