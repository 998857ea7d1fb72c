"""Custom state with event-time timers, list and map state, and state that expires.

Sessions here are kept and closed by the processor itself: rows of a user are merged into open intervals, a timer is set for the time at
which the first of them would end, and all that the watermark has passed is put out by the timer, also if the user never comes back. State per user is its open
intervals, not its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloft.functions.times import stood
from sparkloft.plans.registry import query
from sparkloft.streaming.event_time import SESSIONS
from sparkloft.streaming.streams import event_stream, rocksdb, run_to_end

GAP = 6 * 3_600_000_000


def merged(intervals: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Intervals (start, last, rows) less than gap apart made one; in any order, and each only once."""
    out: list[list[int]] = []
    for start, last, n in sorted(intervals):
        if out and start < out[-1][1] + gap:
            out[-1][1], out[-1][2] = max(out[-1][1], last), out[-1][2] + n
        else:
            out.append([start, last, n])
    return [tuple(x) for x in out]


class TimedSessions(StatefulProcessor):
    """Open sessions of a key as list state; one timer a key stands at the end of the session that ends first, and closes all that the
    watermark has passed. A key's state is thus read once for all of them. Times are microseconds, timers milliseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long")

    def _due(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def _timer(self, known: list[tuple[int, int, int]]) -> int | None:
        """Of sessions in order: the end of the first."""
        return self._due(known[0][1]) if known else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(x) for x in self.open.get()]
        before = self._timer(known)
        for b in rows:  # rows become intervals batch by batch
            known = merged(known + [(int(t), int(t), 1) for t in b["at"]], self.gap)
        self.open.put(known)
        after = self._timer(known)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        known = [tuple(x) for x in self.open.get()]
        ended = [x for x in known if self._due(x[1]) <= passed]
        left = [x for x in known if self._due(x[1]) > passed]
        if left:
            self.open.put(left)
            self.handle.registerTimer(self._timer(left))
        else:
            self.open.clear()
        if ended:
            yield pd.DataFrame([(key[0], *x) for x in ended], columns=["user_id", "start", "last", "n"])

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """events: a stream with user_id and a watermark on ts. Sessions that the watermark has passed, in micros: user_id, start, last, n."""
    rows = events.select("user_id", F.unix_micros("ts").alias("at"), "ts").groupBy("user_id")
    return rows.transformWithStateInPandas(TimedSessions(gap), "user_id long, start long, last long, n long", "Append", "EventTime")


@query(f"SELECT * FROM ({SESSIONS}) WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a timer has closed; those that the last watermark has not reached are still open."""
    with rocksdb(spark):
        out = run_to_end(timed_sessions(event_stream(spark, sf_dir)))
    return out.select("user_id", stood(F.col("start")).alias("start"), stood(F.col("last")).alias("last"), "n")


class FirstOfKind(StatefulProcessor):
    """The first row of each kind that a key has not had before, as far as its state remembers: a map whose entries expire."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple[int, int]] = {}
        for b in rows:
            for kind, at, event in zip(b["event_type"], b["at"], b["event_id"]):
                first[kind] = min(first.get(kind, (at, event)), (at, event))
        new = {k: v for k, v in first.items() if not self.seen.containsKey((k,))}
        for kind, (at, _) in new.items():
            self.seen.updateValue((kind,), (int(at),))
        if new:
            yield pd.DataFrame([(key[0], kind, event) for kind, (_, event) in sorted(new.items())], columns=["user_id", "event_type", "event_id"])

    def close(self) -> None:
        pass


def first_of_kind(events: DataFrame, ttl_ms: int) -> DataFrame:
    rows = events.select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("at")).groupBy("user_id")
    return rows.transformWithStateInPandas(FirstOfKind(ttl_ms), "user_id long, event_type string, event_id long", "Append", "ProcessingTime")


@query("SELECT user_id, event_type, min_by(event_id, ts) AS event_id FROM events GROUP BY ALL")
def stream_first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first event of each type; a type not met for a day of processing counts as new again."""
    with rocksdb(spark, empty_batches=False):
        return run_to_end(first_of_kind(event_stream(spark, sf_dir), 86_400_000))
