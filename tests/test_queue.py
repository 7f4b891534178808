"""States of a queue: the table's fold, the stream's timers and a plain loop agree."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from paperloom.streaming import queue as Q

RULES = Q.Rules(retries=1, timeout=60_000)
SCHEMA = "item string, ts timestamp, seq long, event string, error string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def soup(n=900, items=12):
    rng = random.Random(5)
    kinds = ["enqueue", "start", "done", "start", "fail", "skip", "cancel", "start", "enqueue", "odd"]
    return [(f"i{rng.randrange(items)}", at(k * 4 + rng.randrange(4)), k, rng.choice(kinds), rng.choice(["boom", None])) for k in range(n)]


def plain(events, until):
    found = {}
    for item, ts, _, event, error in sorted(events, key=lambda e: (e[1], e[2])):
        found.setdefault(item, Q.Item(RULES, None)).apply(int(ts.timestamp() * 1000), event, error)
    for one in found.values():
        one.settle(int(until.timestamp() * 1000))
    return {k: (v.status, v.attempts, v.error) for k, v in found.items() if v.status}


def test_single_rules():
    def run(*events):
        one = Q.Item(RULES, None)
        for t, event in events:
            one.apply(t, event, "why")
        return one.status, one.attempts, one.error

    assert run((0, "start")) == (None, 0, None) and run((0, "enqueue")) == ("pending", 0, None)
    assert run((0, "enqueue"), (1, "start"), (2, "fail")) == ("pending", 1, "why")
    assert run((0, "enqueue"), (1, "start"), (2, "fail"), (3, "start"), (4, "fail")) == ("error", 2, "why")
    assert run((0, "enqueue"), (1, "start"), (60_000, "done")) == ("done", 1, None)
    assert run((0, "enqueue"), (1, "start"), (60_001, "done")) == ("pending", 1, "timeout")
    assert run((0, "enqueue"), (1, "start"), (2, "cancel")) == ("converting", 1, None) and run((0, "enqueue"), (2, "cancel"), (3, "enqueue")) == ("pending", 0, None)
    assert run((0, "enqueue"), (1, "start"), (2, "skip")) == ("pending", 0, None)


def test_table_is_the_loop(spark):
    events = soup()
    until = max(e[1] for e in events)
    made = {r["item"]: (r["status"], r["attempts"], r["error"]) for r in Q.states(spark.createDataFrame(events, SCHEMA).repartition(5), RULES).collect()}
    assert made == plain(events, until) and {s for s, _, _ in made.values()} >= {"pending", "error"}
    assert Q.states(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_replayed_stream_is_the_table(spark, tmp_path):
    """Files in an order of their own, rows out of order within the delay; a last event moves the watermark past all timers."""
    events = soup(400, 8)
    rng = random.Random(1)
    jittered = sorted(events, key=lambda e: e[1] + dt.timedelta(seconds=rng.randrange(100)))
    end = max(e[1] for e in events) + dt.timedelta(hours=2)
    inbox = tmp_path / "in"
    inbox.mkdir()
    for k in range(0, len(jittered), 80):
        spark.createDataFrame(jittered[k : k + 80], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/part{k:04d}")
    spark.createDataFrame([("clock", end, 10**6, "odd", None)], SCHEMA).coalesce(1).write.json(f"{tmp_path}/part9999")

    def replay(folders):
        for folder in folders:
            for f in sorted((tmp_path / folder).glob("part-*.json")):
                f.rename(inbox / f"{folder}.json")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox))
        out = Q.stream_states(stream, "120 seconds", RULES).writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"))
        out.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(300)

    folders = sorted(p.name for p in tmp_path.glob("part[0-9]*"))
    replay(folders[:2])
    replay(folders[2:])  # a second run goes on from the first's state
    changes = spark.read.parquet(f"{tmp_path}/out")
    made = {r["item"]: (r["status"], r["attempts"], r["error"]) for r in Q.latest(changes).collect()}
    assert made == plain(events, end - dt.timedelta(seconds=120))
    assert changes.where("error = 'timeout'").count() > 0 and changes.groupBy("item", "version").count().where("count > 1").isEmpty()
    assert changes.where(F.col("status") == "converting").count() > 10
