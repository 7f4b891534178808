"""Digits of doubles and packed numbers against exact decimals."""

from __future__ import annotations

import math
import random
import struct
from decimal import ROUND_HALF_UP, Context, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from paperloom.functions import cellformat as C
from paperloom.functions import exact as X


def plain(value, places):
    if value is None or not math.isfinite(value):
        return None
    size = abs(value)
    if size >= 1e21:
        mantissa, _, exponent = repr(size).partition("e+")
        if not exponent:  # written out
            sign, digits, e = Decimal(repr(size)).as_tuple()
            digits = "".join(map(str, digits)).rstrip("0")
            mantissa, exponent = digits[0] + ("." + digits[1:] if digits[1:] else ""), str(e + len(Decimal(repr(size)).as_tuple()[1]) - 1)
        return ("-" if value < 0 else "") + f"{mantissa.removesuffix('.0')}e+{int(exponent)}"
    made = Decimal(size).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP, context=Context(prec=2000))
    return ("-" if value < 0 else "") + f"{made:f}"


CASES = [(1.005, 2), (0.125, 2), (2.5, 0), (0.5, 0), (1.5, 0), (-0.5, 0), (-1.005, 2), (0.0, 3), (-0.0, 2), (999.9999, 2), (0.9999999, 3), (5e-324, 2), (5e-324, 330), (2.2250738585072014e-308, 20), (1e-7, 3), (1e-7, 10), (4.35, 1), (0.1, 20), (0.1, 60), (1 / 3, 17), (2**53 + 2.0, 2), (1e20, 3), (9.99e20, 1), (123456789012345680.0, 0), (1e21, 2), (1.234e25, 2), (1.7976931348623157e308, 0), (float("nan"), 2), (float("inf"), 2), (None, 2), (8.345, 2), (0.049999999999999996, 1), (0.05, 1), (99999999.995, 2), (0.0078125, 6), (0.00390625, 7), (2**-30 + 2**-60, 30)]


def test_fixed_is_exact(spark):
    rng = random.Random(2)
    rows = list(CASES)
    rows += [(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 19), rng.randint(0, 12)) for _ in range(600)]
    rows += [((2 * rng.getrandbits(rng.randint(1, 40)) + 1) / 2 ** rng.randint(1, 40), rng.randint(0, 9)) for _ in range(600)]  # ties among them
    rows += [(round(rng.uniform(0, 2000), 3), 2) for _ in range(300)] + [(struct.unpack("<d", rng.randbytes(8))[0], rng.randint(0, 40)) for _ in range(300)]
    df = spark.createDataFrame([(k, v, n) for k, (v, n) in enumerate(rows)], "k int, v double, n int")
    for r in df.select("k", "v", "n", X.fixed(F.col("v"), F.col("n")).alias("shown")).collect():
        assert r["shown"] == plain(r["v"], r["n"]), (r["v"], r["n"])
    ties = sum(v is not None and math.isfinite(v) and (Fraction(abs(v)) * 10**n * 2 % 2 == 1) for v, n in rows)
    assert ties > 20


def test_both_ways_agree_and_scaling_is_exact(spark):
    rng = random.Random(5)
    values = [2.0**k for k in range(-1074, 69)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 69)] + [rng.uniform(0, 10) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("p", X.taken_apart(F.col("v")))
    for r in df.collect():
        m, k = r["p"]["m"], r["p"]["k"]
        assert 2**52 <= m < 2**56 and math.ldexp(m, -k) == r["v"] or r["v"] < 2**-1021 and math.ldexp(m, -k) == r["v"]
    some = df.where("p.k > 0 AND p.k <= 55").select("v", X.by_longs(F.col("p.m"), F.col("p.k"), F.lit(1)).alias("a"), X.by_limbs(F.col("p.m"), F.col("p.k"), F.lit(1)).alias("b"))
    assert some.where("a <> b OR a IS NULL OR b IS NULL").isEmpty() and some.count() > 300


def test_no_python_in_formats(spark):
    df = spark.range(3).select(C.format_cell(F.concat("id", F.lit(".125")), F.lit("#,##0.00"), F.lit(False)).alias("a"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and [r["a"] for r in df.collect()] == ["0.13", "1.13", "2.13"]


@pytest.mark.parametrize("flag", [0, 1])
def test_packed_numbers(spark, flag):
    rng = random.Random(7)
    rows, expected = [], {}
    for k in range(400):
        if k % 2:
            bits = rng.getrandbits(30)
            value = float(bits - (1 << 30) if bits >> 29 else bits)
            rk = bits << 2 | 2 | flag
        else:
            high = struct.unpack(">I", struct.pack(">d", rng.choice([0.0, -0.0, 1.5, -2.25, 1e300, 1e-310, 0.1, 12345.678, float("inf"), rng.uniform(-1e6, 1e6)]))[:4])[0] & 0xFFFFFFFC
            value = struct.unpack(">d", struct.pack(">II", high, 0))[0]
            rk = high | flag
        expected[k] = None if not math.isfinite(value) else value / 100 if flag else value
        rows.append((k, rk - (1 << 32) if rk >> 31 else rk))
    for r in spark.createDataFrame(rows, "k int, rk int").select("k", X.packed_number(F.col("rk")).alias("v")).collect():
        assert r["v"] == expected[r["k"]]
