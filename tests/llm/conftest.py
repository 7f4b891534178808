"""Odd tables for the training-data operators."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, piece int, fp long, keep_id long, _salt int"
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
TEXTS = [None, "", "", " \n\t ", "one", "One", "one", "a b c d e", "a b c d e", LONG, LONG, "naïve café ½ 😀 text", "trailing  spaces \n\n and lines", "x" * 5000, "the quick brown fox jumps over the lazy dog " * 12, "the quick brown fox jumps over the lazy dog " * 12 + "again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), 0.5, "d", 1, 2, 3, 4) for k, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[7], None, None, None, None, None, None, None, None, None), (None, "one", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[4], rows[4], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_of(spark, tmp_path_factory):
    """Writes tables as a folder of Parquet."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
