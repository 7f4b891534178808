"""Recall and reading order against plain counts."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paperloom.operators import fidelity as D


def plain(text):
    return re.sub(r"[\W_]+", "", (text or "").lower())


def counts(text):
    t = plain(text)
    return Counter(t[k : k + 5] for k in range(max(1, len(t) - 4))) if t else Counter()


def increasing(values):
    best = []
    for k, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(k) if values[j] < v), default=0))
    return max(best, default=0)


def texts():
    rng = random.Random(8)
    a = ["\n".join(rng.choice(["alpha", "Beta,", "line 7", "", "γάμμα", "dup"]) + " " + str(rng.randrange(30)) for _ in range(rng.randrange(40))) for _ in range(40)]
    b = []
    for t in a:
        lines = t.split("\n")
        for _ in range(rng.randrange(6)):
            i, j = rng.randrange(len(lines)), rng.randrange(len(lines))
            lines[i], lines[j] = lines[j], lines[i]
        b.append("\n".join(x for x in lines if rng.random() < 0.9))
    return [*a, None, "", "abc", "abcabc"], [*b, "x", "some", "abc", None]


def test_recall_and_order(spark):
    a, b = texts()
    expected, actual = (spark.createDataFrame(list(enumerate(t)), "doc long, text string").repartition(3) for t in (a, b))
    for r in D.recall(expected, actual.unionByName(spark.createDataFrame([(900, "only here")], actual.schema)), ["doc"]).collect():
        x, y = counts(a[r["doc"]]), counts(b[r["doc"]])
        assert (r["grams"], r["found"]) == (sum(x.values()), sum((x & y).values())) and (r["recall"] is None) == (not x)
    found = {r["doc"]: (r["lines"], r["in_order"]) for r in D.reading_order(expected, actual, ["doc"]).collect()}
    assert len(found) == len(a) and max(n for n, _ in found.values()) > 5
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = ([plain(t) for t in (s or "").split("\n")] for s in (x, y))
        common = [t for t in p if t and p.count(t) == 1 and q.count(t) == 1]
        assert found[k] == (len(common), increasing([q.index(t) for t in common]))


def test_longest_increasing(spark):
    rng = random.Random(3)
    rows = [(rng.choices(range(30), k=rng.randrange(40)),) for _ in range(60)] + [([],), (list(range(300)),), (list(range(300, 0, -1)),)]
    for r in spark.createDataFrame(rows, "v array<int>").select("v", D.longest_increasing(F.col("v")).alias("n")).collect():
        assert r["n"] == increasing(r["v"])


def test_shared_grams_are_multisets_in_any_script(spark):
    rng = random.Random(9)
    letters = ["ab", "가나다라힣", "𐐨𐐩a", "".join(map(chr, range(0x4E00, 0x9F00)))]
    pairs = [("".join(rng.choice(x) for _ in range(rng.randrange(3, 300))), "".join(rng.choice(x) for _ in range(rng.randrange(3, 300)))) for x in letters for _ in range(5)]
    pairs += [(a, a[40:] + a[:50]) for a, _ in pairs] + [("abc", "abc"), ("abc", "abcdef"), ("abcdef", "abc"), ("", "abc"), ("", "")]
    expected = {k: (sum(counts(a).values()), sum((counts(a) & counts(b)).values())) for k, (a, b) in enumerate(pairs)}
    assert {k: D.shared_grams(a, b, 5) for k, (a, b) in enumerate(pairs)} == expected
    left, right = (spark.createDataFrame([(k, p[i]) for k, p in enumerate(pairs)], "id int, text string") for i in (0, 1))
    assert {r["id"]: (r["grams"], r["found"]) for r in D.recall(left, right, ["id"]).collect()} == expected
    # one document of several rows: all go by their n-grams, and agree with those compared where they meet
    more = D.recall(left.unionByName(left.where("id = 0")), right, ["id"]).collect()
    first = counts(pairs[0][0])
    assert {r["id"]: (r["grams"], r["found"]) for r in more} == expected | {0: (2 * sum(first.values()), sum(((first + first) & counts(pairs[0][1])).values()))}


def test_no_gram_of_a_document_is_shuffled(spark):
    left = spark.createDataFrame([(1, "a" * 100)], "id int, text string")
    plan = D.recall(left, left, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan
