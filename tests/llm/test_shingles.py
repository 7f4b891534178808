"""Near copies of the pipeline against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline as P  # noqa: E402

from paperloom.llm import components, shingles, simhash  # noqa: E402

from .test_operators import brute_print  # noqa: E402


def words_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """Component of each row: the least id over links of 4 bits or of similarity 0.8; and the similar pairs."""
    sets, prints, top, pairs = [words_of(t) for _, t in rows], [brute_print(t) for _, t in rows], list(range(len(rows))), []

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = both and both / len(sets[i] | sets[j]) >= 0.8
            if near:
                pairs.append((j, i))
            if near or (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [rows[root(k)][0] for k in range(len(rows))], pairs


def near_copies():
    rng, rows = random.Random(3), []
    for k in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 2 + len(base) // 40)):
                words[rng.randrange(len(base))] = f"new{rng.randrange(9)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows) + k, t) for k, t in enumerate([None, "", "one two", "One  two", "one two three four five", "a b c d e f"])]


def test_pipeline_links_by_similarity(spark):
    rows = near_copies()
    expected, pairs = brute(rows)
    prints = [brute_print(t) for _, t in rows]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in pairs) >= 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = {r["doc_id"]: r["component_id"] for r in simhash.classify(docs, similar=0.8).collect()}
    assert [made[d] for d, _ in rows] == expected
    assert {r["doc_id"] for r in P.without_near_copies(spark, docs, "").collect()} == set(expected)


@pytest.mark.parametrize("block_bytes", [4000, 1 << 24])
def test_links_in_cells_and_blocks(spark, block_bytes):
    rows = near_copies()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = shingles.Candidates(docs, simhash.fingerprint, block_bytes=block_bytes)
    first = found.represented()
    roots = components.connected(first)
    links = {(r["a"], r["b"]) for r in first.unionByName(found.remaining(roots)).collect()} | {(r["a"], r["b"]) for r in roots.collect()}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    prints = [sign(brute_print(t)) for _, t in rows]
    top = {p: p for p in prints}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in links:
        top[root(a)] = root(b)
    assert all(root(prints[i]) == root(prints[j]) for i, j in brute(rows)[1])


def test_copies_of_a_copy_that_its_representative_misses(spark):
    """A star of independent copies with a chain at one of them: only the second comparison finds the chain."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]

    def edited(words, places):
        words = list(words)
        for k in places:
            words[k] = f"new{rng.randrange(9000)}"
        return words

    star = [edited(base, rng.sample(range(200), 3)) for _ in range(30)]
    chain = [edited(base, [10, 40])]
    for k in range(5):
        chain.append(edited(chain[-1], [70 + 25 * k, 80 + 25 * k]))
    rows = list(enumerate(" ".join(w) for w in [base, *star, *chain]))
    expected, pairs = brute(rows)
    assert len(set(expected)) == 1 and (0, len(rows) - 1) not in pairs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in simhash.classify(docs, similar=0.8).collect()} == {0}


def test_between_compares_all_pairs_of_groups():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.int64) for _ in range(40)]
        groups = rng.integers(0, 12, 40)
        expected = set()
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if groups[i] != groups[j] and both / (len(sets[i]) + len(sets[j]) - both) >= 0.6:
                    expected.add(frozenset((int(groups[i]), int(groups[j]))))
        assert {frozenset(map(int, p)) for p in shingles.between(sets, groups, 0.6)} == expected
