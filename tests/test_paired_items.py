"""Residual tokens over more benchmark items than 40."""

from __future__ import annotations

from paperloom import plans


def test_every_item_takes_part(spark, tmp_path):
    spark.createDataFrame([(k, "plain") for k in range(90)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:04d}")
    spark.createDataFrame([(2 * k, word(k)) for k in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = {tuple(r) for r in plans.QUERIES["q_residual_tokens"](spark, str(tmp_path)).select("doc_id", "token").collect()}
    assert made == {(k, word(k % 60)) for k in range(90)}
