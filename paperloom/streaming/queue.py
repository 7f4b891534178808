"""States of conversions in a queue, from the events that drive them: as a stream with timers, and over a table.

An item is pending, converting, done, error or cancelled. What each event does:

| event | state before | state after |
|-|-|-|
| enqueue | none, done, error, cancelled | pending, attempts from 0 |
| start | pending | converting, one attempt more |
| done | converting | done |
| fail | converting | pending while attempts are at most the retries, else error |
| skip | converting | pending, the attempt isn't counted |
| cancel | pending | cancelled |

Any other event changes nothing. An item that has been converting for ``timeout`` fails with "timeout" at that moment, if
nothing ended it before. Events of one item count in the order of time, then of ``seq``.

The stream holds an item's events back until the watermark has passed them, so that late ones find their place; what is
later than the watermark allows is dropped, as by Spark's own operators. A timer wakes an item for its next event or its
timeout. State is an item's own: its events of one delay and a few numbers. Rows come out when a state changes; of the rows
of one item the one with the largest ``changed``, then ``version``, is its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

STATE = "item string, status string, attempts int, error string, changed timestamp, version long"


@dataclass(frozen=True)
class Rules:
    """Attempts beyond the first that a failure allows, and milliseconds of converting after which it's a failure."""

    retries: int = 2
    timeout: int = 3_600_000


def states(events: DataFrame, rules: Rules = Rules(), until: Column | None = None) -> DataFrame:  # noqa: B008
    """item, status, attempts, error, changed of a table of events (item, ts, seq, event, error), timeouts up to ``until``.

    ``until`` is the latest event's time by default. A fold over each item's events in the JVM.
    """
    if until is None:
        until = F.timestamp_millis(F.lit(events.agg(F.unix_millis(F.max(F.col("ts").cast("timestamp")))).first()[0]).cast("long"))
    now = F.unix_millis(until)
    grouped = events.groupBy("item").agg(F.max(now).alias("_now"), F.array_sort(F.collect_list(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "seq", "event", "error"))).alias("_e"))

    def made(status, attempts, started, error, changed) -> Column:
        lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        return F.struct(lit(status, "string").alias("status"), lit(attempts, "int").alias("attempts"), lit(started, "long").alias("started"), lit(error, "string").alias("error"), lit(changed, "long").alias("changed"))

    def failed(s: Column, at: Column, why: Column) -> Column:
        again = s["attempts"] <= rules.retries
        return made(F.when(again, "pending").otherwise("error"), s["attempts"], None, why, at)

    def settled(s: Column, at: Column) -> Column:
        end = s["started"] + rules.timeout
        return F.when((s["status"] == "converting") & (end <= at), failed(s, end, F.lit("timeout"))).otherwise(s)

    def applied(s: Column, e: Column) -> Column:
        is_, was, at = e["event"], s["status"], e["at"]
        return (
            F.when((is_ == "enqueue") & (was.isNull() | was.isin("done", "error", "cancelled")), made("pending", 0, None, None, at))
            .when((is_ == "start") & (was == "pending"), made("converting", s["attempts"] + 1, at, None, at))
            .when((is_ == "done") & (was == "converting"), made("done", s["attempts"], None, None, at))
            .when((is_ == "fail") & (was == "converting"), failed(s, at, e["error"]))
            .when((is_ == "skip") & (was == "converting"), made("pending", s["attempts"] - 1, None, None, at))
            .when((is_ == "cancel") & (was == "pending"), made("cancelled", s["attempts"], None, None, at))
            .otherwise(s)
        )

    step = lambda s, e: once(settled(s, e["at"]), lambda t: applied(t, e))
    last = F.aggregate("_e", made(None, 0, None, None, None), step)
    out = grouped.select("item", once(last, lambda s: settled(s, F.col("_now"))).alias("_s")).where("_s.status IS NOT NULL")
    return out.select("item", "_s.status", "_s.attempts", "_s.error", F.timestamp_millis("_s.changed").alias("changed"))


class Item:
    """One item's state, as the stream keeps it."""

    def __init__(self, rules: Rules, kept: dict | None):
        self.rules, self.changes = rules, []
        kept = kept or {}
        self.status, self.attempts, self.started, self.error = kept.get("status"), kept.get("attempts", 0), kept.get("started"), kept.get("error")
        self.version, self.waiting = kept.get("version", 0), [tuple(e) for e in kept.get("waiting", [])]

    def to(self, status: str, at: int, error: str | None = None, started: int | None = None) -> None:
        self.status, self.error, self.started, self.version = status, error, started, self.version + 1
        self.changes.append((status, self.attempts, error, at, self.version))

    def fail(self, at: int, why: str | None) -> None:
        self.to("pending" if self.attempts <= self.rules.retries else "error", at, why)

    def settle(self, at: int) -> None:
        if self.status == "converting" and self.started + self.rules.timeout <= at:
            self.fail(self.started + self.rules.timeout, "timeout")

    def apply(self, at: int, event: str, error: str | None) -> None:
        self.settle(at)
        if event == "enqueue" and self.status in (None, "done", "error", "cancelled"):
            self.attempts = 0
            self.to("pending", at)
        elif event == "start" and self.status == "pending":
            self.attempts += 1
            self.to("converting", at, started=at)
        elif event == "done" and self.status == "converting":
            self.to("done", at)
        elif event == "fail" and self.status == "converting":
            self.fail(at, error)
        elif event == "skip" and self.status == "converting":
            self.attempts -= 1
            self.to("pending", at)
        elif event == "cancel" and self.status == "pending":
            self.to("cancelled", at)

    def advance(self, watermark: int) -> None:
        """Apply what the watermark has passed."""
        due = sorted(e for e in self.waiting if e[0] <= watermark)
        self.waiting = [e for e in self.waiting if e[0] > watermark]
        for at, _, event, error in due:
            self.apply(at, event, error or None)
        self.settle(watermark)

    def wakes(self) -> int | None:
        times = [e[0] for e in self.waiting] + ([self.started + self.rules.timeout] if self.status == "converting" else [])
        return min(times, default=None)

    def kept(self) -> str:
        return json.dumps({"status": self.status, "attempts": self.attempts, "started": self.started, "error": self.error, "version": self.version, "waiting": self.waiting})


def stream_states(events: DataFrame, delay: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Changes of state (STATE) of a stream of events (item, ts, seq, event, error); output mode is update."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        item = Item(rules, json.loads(state.get[0]) if state.exists else None)
        if not state.hasTimedOut:
            for batch in batches:
                for at, seq, event, error in zip(batch["at"], batch["seq"], batch["event"], batch["error"], strict=True):
                    item.waiting.append((int(at), int(seq), event, error or ""))
        watermark = state.getCurrentWatermarkMs()
        item.advance(watermark)
        state.update((item.kept(),))
        wake = item.wakes()
        if wake is not None:
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        if item.changes:
            rows = [(key[0], s, a, e, pd.Timestamp(at, unit="ms", tz="UTC"), v) for s, a, e, at, v in item.changes]
            yield pd.DataFrame(rows, columns=["item", "status", "attempts", "error", "changed", "version"])

    keyed = events.withWatermark("ts", delay).select("item", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "seq", "event", "error")
    return keyed.groupBy("item").applyInPandasWithState(run, STATE, "kept string", "update", "EventTimeTimeout")


def latest(changes: DataFrame) -> DataFrame:
    """The state of each item from its changes; a plain aggregation."""
    best = F.max_by(F.struct("status", "attempts", "error", "changed"), F.struct("changed", "version")).alias("_s")
    return changes.groupBy("item").agg(best).select("item", "_s.*")
