"""Free names against a loop over requests."""

from __future__ import annotations

import random
import re

import pytest

from paperloom.operators import names as N


def shape(path):
    m = re.match(r"(?s)^(.*?)(\.[^./\\]+)?\Z", path)
    return m[1], m[2] or ""


def plain_numbers(requests, existing):
    """How many requests of each path and policy get which targets: numbers are a set, whatever the order among requests."""
    taken = set(existing) | {p for p, policy, _ in requests if policy == "overwrite"}
    out, rest = {}, []
    for path, policy, k in sorted((r for r in requests if r[0] is not None and r[1] != "overwrite"), key=lambda r: r[2]):
        if path not in taken and path not in {t for t in out.values()}:
            out[k] = path
        else:
            rest.append((path, policy, k))
    used = taken | set(out.values())
    for path, policy, k in rest:
        if policy == "skip":
            out[k] = None
            continue
        stem, ext = shape(path)
        n = 1
        while f"{stem} ({n}){ext}" in used:
            n += 1
        out[k] = f"{stem} ({n}){ext}"
        used.add(out[k])
    out.update({k: p for p, policy, k in requests if policy == "overwrite"})
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_the_smallest_free_ones(spark, seed):
    rng = random.Random(seed)
    pool = ["a.md", "b.md", "a (1).md", "a (2).md", "a (1) (1).md", "dir.x/a", "dir.x/a (1)", "a (01).md", "c (3).md", "c.md", ".md", "x (1)"]
    existing = rng.sample(pool, 5) + [f"a ({n}).md" for n in rng.sample(range(1, 30), 8)] + [f"c ({n}).md" for n in range(1, 7)] + ["a.md", "a.md"]
    requests = [(rng.choice(pool) if rng.random() < 0.6 else "a.md", rng.choice(["rename", "rename", None, "skip", "overwrite"]), k) for k in range(150)] + [(None, "rename", 999)]
    made = N.allotted(spark.createDataFrame(requests, "path string, policy string, order long").repartition(4), spark.createDataFrame([(p,) for p in existing] + [(None,)], "path string"))
    found = {r["order"]: r["target"] for r in made.collect()}
    expected = plain_numbers([r for r in requests if r[0]], existing)
    assert found.pop(999) is None and set(found) == set(expected)
    own = {p for p in existing} | {p for p, policy, _ in requests if policy == "overwrite"}
    targets = [t for k, t in found.items() if t is not None and requests[k][1] != "overwrite"]
    assert len(set(targets)) == len(targets) and not set(targets) & own
    assert sorted(map(str, found.values())) == sorted(map(str, expected.values()))
    for path in {p for p, _, _ in requests if p}:
        of = lambda d: sorted(str(d[k]) for p, policy, k in requests if p == path and policy != "skip")  # noqa: B023, E731
        assert of(found) == of(expected)


def test_empty_and_hot(spark):
    none = spark.createDataFrame([], "path string, policy string, order long")
    assert N.allotted(none, none.select("path")).count() == 0
    hot = spark.range(5000).selectExpr("'a.md' AS path", "'rename' AS policy", "id AS order").repartition(7)
    made = [r["target"] for r in N.allotted(hot, spark.createDataFrame([("a (3).md",)], "path string")).collect()]
    assert set(made) == {"a.md"} | {f"a ({n}).md" for n in range(1, 5001) if n != 3}
