"""Decimal digits of doubles as they are: every double is a whole number over a power of two, and is rounded as that.

A value is taken apart into m / 2**k by exact scaling. Where the fraction times a power of ten fits a long, one product and
one shift give its digits; elsewhere the fraction is an array of 30-bit limbs, from which each product with 10**9 takes nine
more digits. What is left decides the rounding: half and more goes up. So 1.005 to two places is 1.00, since the double is a
little less, and 0.125 is 0.13. Everything is expressions of the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

LIMB, CHUNK = 30, 9
#: From here on digits are written with an exponent.
EXPONENT_FROM = 1e21
POWERS = [10**k for k in range(19)]


def left(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", x, bits if isinstance(bits, Column) else F.lit(bits))


def right(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", x, bits if isinstance(bits, Column) else F.lit(bits))


def power(n: Column) -> Column:
    """10**n as a long, n from 0 to 18."""
    return F.get(F.array(*[F.lit(p).cast("long") for p in POWERS]), n.cast("int"))


def taken_apart(value: Column) -> Column:
    """(m, k) with value = m / 2**k, for finite values above zero: m is a long below 2**56, k may be negative.

    The logarithm may be off by one, so m has up to 56 bits rather than 53. Two steps of scaling keep small values normal.
    """
    k = (F.lit(54) - F.floor(F.log2(value))).cast("int")

    def parts(k: Column) -> Column:
        half = F.floor(k / 2).cast("int")
        return F.struct((value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), k - half)).cast("long").alias("m"), k.alias("k"))

    return once(k, parts)


def whole_number(m: Column, k: Column) -> Column:
    """Digits of m * 2**-k for k of zero and less, values below EXPONENT_FROM."""
    return (m.cast("decimal(18,0)") * left(F.lit(1).cast("long"), F.least(-k, F.lit(20))).cast("decimal(8,0)")).cast("decimal(38,0)").cast("string")


def joined(whole: Column, digits: Column, places: Column) -> Column:
    return F.when(places > 0, F.concat(whole.cast("string"), F.lit("."), digits)).otherwise(whole.cast("string"))


def by_longs(m: Column, k: Column, places: Column) -> Column:
    """k from 1 to 62, and the fraction's bits and the places' together in a long."""
    whole = right(m, k)
    scaled = (m - left(whole, k)) * power(places)

    def digits(scaled: Column) -> Column:
        down = right(scaled, k)
        return down + F.when(scaled - left(down, k) >= left(F.lit(1).cast("long"), k - 1), 1).otherwise(0)

    def text(n: Column) -> Column:
        over = n >= power(places)  # the fraction was rounded up to one
        return joined(whole + over.cast("long"), F.lpad(F.when(over, F.lit(0).cast("long")).otherwise(n).cast("string"), places, "0"), places)

    return once(once(scaled, digits), text)


def by_limbs(m: Column, k: Column, places: Column) -> Column:
    """Any k above zero and any number of places."""
    mask = (1 << LIMB) - 1
    whole = F.when(k < 63, right(m, F.least(k, F.lit(62)))).otherwise(F.lit(0).cast("long"))
    fraction = F.when(k < 63, m - left(whole, F.least(k, F.lit(62)))).otherwise(m)
    count = F.ceil(k / LIMB).cast("int")

    def limb(i: Column) -> Column:
        """Bits of the fraction, which is filled up to whole limbs, from the highest."""
        shift = (count - 1 - i) * LIMB - (count * LIMB - k)
        moved = F.when(shift > 62, F.lit(0).cast("long")).when(shift >= 0, right(fraction, F.least(shift, F.lit(62)))).otherwise(left(fraction, F.least(-shift, F.lit(62))))
        return moved.bitwiseAND(F.lit(mask).cast("long"))

    none = F.array().cast("array<long>")

    def times(limbs: Column, factor: Column) -> Column:
        """(carry, limbs) of limbs * factor: the carry is the product's whole part."""

        def step(acc: Column, x: Column) -> Column:
            product = x * factor + acc["carry"]
            return F.struct(right(product, LIMB).alias("carry"), F.concat(F.array(product.bitwiseAND(F.lit(mask).cast("long"))), acc["out"]).alias("out"))

        return F.aggregate(F.reverse(limbs), F.struct(F.lit(0).cast("long").alias("carry"), none.alias("out")), step)

    chunks = F.when(places > 0, F.sequence(F.lit(0), F.ceil(places / CHUNK).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    size = lambda c: F.least(F.lit(CHUNK), places - c * CHUNK).cast("int")

    def expand(acc: Column, c: Column) -> Column:
        return once(times(acc["limbs"], power(size(c))), lambda p: F.struct(p["out"].alias("limbs"), F.concat(acc["digits"], F.array(p["carry"])).alias("digits")))

    def rounded(done: Column) -> Column:
        up = F.when(F.get(done["limbs"], F.lit(0)) >= 1 << LIMB - 1, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

        def add(acc: Column, x: Column) -> Column:
            """From the last chunk: one that is full hands its carry on."""
            n = F.size(acc["out"])
            full = power(size(F.size(done["digits"]) - 1 - n))
            sum_ = x + acc["carry"]
            return F.struct(F.when(sum_ >= full, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("carry"), F.concat(F.array(F.when(sum_ >= full, sum_ - full).otherwise(sum_)), acc["out"]).alias("out"))

        def text(acc: Column) -> Column:
            return joined(whole + acc["carry"], F.array_join(F.transform(acc["out"], lambda x, i: F.lpad(x.cast("string"), size(i), "0")), ""), places)

        return once(F.aggregate(F.reverse(done["digits"]), F.struct(up.alias("carry"), none.alias("out")), add), text)

    start = F.struct(F.transform(F.sequence(F.lit(0), count - 1), limb).alias("limbs"), none.alias("digits"))
    return once(F.aggregate(chunks, start, expand), rounded)


def fixed(value: Column, places: Column) -> Column:
    """The double's exact value with so many places, half away from zero; null for null, NaN and infinite values.

    From 1e21 on: the shortest digits that name the double, with an exponent, whatever the places.
    """

    def of(v: Column) -> Column:
        x, n, parts = v["x"], v["n"], v["parts"]
        m, k = parts["m"], parts["k"]
        zeros = F.repeat(F.lit("0"), n)
        fits = (k <= 62) & (F.least(k, F.lit(56)) + F.ceil(n * 3.33) <= 61)
        digits = F.when(k <= 0, joined(whole_number(m, k), zeros, n)).when(fits, by_longs(m, k, n)).otherwise(by_limbs(m, k, n))
        shortest = F.regexp_replace(F.regexp_replace(x.cast("string"), "E", "e+"), r"\.0e", "e")
        shown = F.when(x == 0, joined(F.lit("0"), zeros, n)).when(x >= EXPONENT_FROM, shortest).otherwise(digits)
        return F.when(~F.isnan(x) & (x < float("inf")) & n.isNotNull(), F.concat(F.when(v["below"], "-").otherwise(""), shown))

    # what is used more than once is bound to a variable first: the value, the places, the parts
    bound = F.struct(F.abs(value).alias("x"), (value < 0).alias("below"), F.greatest(places.cast("int"), F.lit(0)).alias("n"))

    def with_parts(v: Column) -> Column:
        usual = (v["x"] > 0) & (v["x"] < EXPONENT_FROM)
        return once(F.struct(v["x"].alias("x"), v["below"].alias("below"), v["n"].alias("n"), F.when(usual, taken_apart(v["x"])).alias("parts")), of)

    return F.when(value.isNotNull() & places.isNotNull(), once(bound, with_parts))


def packed_number(rk: Column) -> Column:
    """A packed number of a binary workbook, as a double: of 32 bits the lowest two say hundredths (1) and integer (2).

    An integer has the other 30 bits, signed. Else they are the highest bits of a double: sign, exponent and 18 of 52 bits of the
    mantissa; an exponent of all ones is no number and null.
    """
    rk = rk.cast("int")
    integer = right(rk, 2).cast("double")
    exponent = F.shiftrightunsigned(rk, 20).bitwiseAND(F.lit(0x7FF))
    mantissa = rk.bitwiseAND(F.lit(0xFFFFC)).cast("double")
    normal = (mantissa + (1 << 20)) * F.pow(F.lit(2.0), exponent - 1023 - 20)
    small = mantissa * F.pow(F.lit(2.0), F.lit(-1022)) / (1 << 20)
    size = F.when(exponent == 0x7FF, F.lit(None).cast("double")).when(exponent == 0, small).otherwise(normal)
    value = F.when(rk.bitwiseAND(F.lit(2)) == 2, integer).otherwise(F.when(rk < 0, -size).otherwise(size))
    return F.when(rk.bitwiseAND(F.lit(1)) == 1, value / 100).otherwise(value)
