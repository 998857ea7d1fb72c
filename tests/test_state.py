"""Timers, state that expires and table arguments: rows out of order, several batches, nulls, hot keys, wrong calls."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloft.functions.table_arguments import Sessions, sessions
from sparkloft.sources.tables import fresh_dir
from sparkloft.streaming.streams import rocksdb, run_to_end
from sparkloft.streaming.timers import TimedSessions, first_of_kind, merged, timed_sessions

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MINUTE = 60_000_000
SCHEMA = "user_id long, event_type string, event_id long, ts timestamp"


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def brute_sessions(rows, gap):
    """rows: (user, number)."""
    out = []
    for user in {u for u, _ in rows}:
        open_ = []
        for t in sorted(t for u, t in rows if u == user and t is not None):
            if open_ and t < open_[-1][1] + gap:
                open_[-1][1:] = [t, open_[-1][2] + 1]
            else:
                open_.append([t, t, 1])
        out += [(user, *x) for x in open_]
    return sorted(out, key=str)


def test_merged():
    r = random.Random(1)
    points = [r.randrange(500) for _ in range(60)]
    known = []
    for k in range(0, 60, 7):
        known = merged(known + [(t, t, 1) for t in points[k : k + 7]], 9)
    assert [("u", *x) for x in known] == sorted(brute_sessions([("u", t) for t in points], 9), key=lambda x: x[1])


def test_timers_close_sessions_as_the_watermark_passes(spark):
    """A user who never comes back is closed too; rows out of order join two sessions; what is not passed stays open."""
    folder, place = fresh_dir(spark, "arrived"), (fresh_dir(spark, "stream"), fresh_dir(spark, "state"))

    def arrive(*rows):
        spark.createDataFrame([(u, "x", 1, at(m)) for u, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("ts", "10 minutes")
        with rocksdb(spark):
            out = run_to_end(timed_sessions(events, 30 * MINUTE), place=place)
        zero = int(T.timestamp()) * 1_000_000
        return sorted((r.user_id, (r.start - zero) // MINUTE, (r["last"] - zero) // MINUTE, r.n) for r in out.collect())

    assert arrive((1, 0), (1, 50), (2, 5)) == [(1, 0, 0, 1), (2, 5, 5, 1)]
    assert arrive((1, 45), (1, 70), (3, 60)) == [(1, 0, 0, 1), (2, 5, 5, 1)]
    assert arrive((3, 400)) == [(1, 0, 0, 1), (1, 45, 70, 3), (2, 5, 5, 1), (3, 60, 60, 1)]


class OneKey:
    """A key's state and timers, as a handle, its list state, the time and a timer that fires."""

    def __init__(self):
        self.rows, self.timers, self.reads, self.watermark = [], set(), 0, 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove
        self.put, self.clear = lambda rows: setattr(self, "rows", list(rows)), lambda: setattr(self, "rows", [])
        self.getListState = lambda name, schema: self
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: self.watermark

    def get(self):
        self.reads += 1
        return iter(self.rows)


def test_state_is_read_once_for_all_sessions_that_end():
    """500 sessions of a key are open; the work of closing them does not grow with their square."""
    key, minutes = OneKey(), range(0, 50_000, 100)
    held = TimedSessions(30 * MINUTE)
    held.init(key)
    list(held.handleInputRows((7,), iter([pd.DataFrame({"at": [m * MINUTE for m in minutes]})]), key))
    out = []

    def pass_to(minute):
        key.watermark = minute * 60_000
        for due in sorted(t for t in key.timers if t <= key.watermark):
            key.timers.remove(due)
            out.extend(tuple(r) for b in held.handleExpiredTimer((7,), key, key) for r in b.itertuples(index=False))

    pass_to(39_930)
    assert out == [(7, m * MINUTE, m * MINUTE, 1) for m in range(0, 40_000, 100)] and key.reads <= 3
    pass_to(100_000)
    assert len(out) == 500 and not key.rows and not key.timers and key.reads <= 5


def test_session_ends_when_the_watermark_is_there(spark):
    folder = fresh_dir(spark, "arrived")
    spark.createDataFrame([(u, "x", 1, at(m)) for u, m in ((1, 0), (1, 30), (1, 61), (2, 70))], SCHEMA).write.parquet(folder)
    with rocksdb(spark):
        out = run_to_end(timed_sessions(spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("ts", "10 minutes"), 30 * MINUTE))
    zero = int(T.timestamp()) * 1_000_000
    assert sorted((r.user_id, (r.start - zero) // MINUTE) for r in out.collect()) == [(1, 0), (1, 30)]


def test_state_expires(spark):
    def twice(ttl_ms, pause):
        folder, place = fresh_dir(spark, "arrived"), (fresh_dir(spark, "stream"), fresh_dir(spark, "state"))
        for k in range(2):
            rows = [(1, "a", 10 * k + 1, at(k)), (1, "a", 10 * k + 2, at(k)), (1, "b", 10 * k + 3, at(k)), (2, "a", 10 * k + 4, at(k))]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            with rocksdb(spark, empty_batches=False):
                out = run_to_end(first_of_kind(spark.readStream.schema(SCHEMA).parquet(folder), ttl_ms), place=place)
            time.sleep(pause)
        return sorted((r.user_id, r.event_type, r.event_id) for r in out.collect())

    first = [(1, "a", 1), (1, "b", 3), (2, "a", 4)]
    assert twice(3_600_000, 0) == first
    assert twice(1, 1) == sorted(first + [(1, "a", 11), (1, "b", 13), (2, "a", 14)])


@pytest.mark.parametrize("piece", [7, 100, 10**9])
def test_sessions_of_a_table(spark, piece):
    r = random.Random(piece)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randrange(2000)) for _ in range(300)] + [(2, None), (4, None), (5, 10), (5, 19), (5, 28)]
    got = sessions(spark.createDataFrame(rows, "user_id long, at long").repartition(5), 9, piece).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_sessions(rows, 9)
    assert sessions(spark.createDataFrame([], "user_id long, at long")).count() == 0


def test_wrong_calls_say_what_is_wrong(spark):
    spark.udtf.register("sessions_of", F.udtf(Sessions))
    spark.sql("SELECT 1L AS k, 2L AS t, 'x' AS s").createOrReplaceTempView("_some_rows")
    ask = lambda args: spark.sql(f"SELECT * FROM sessions_of({args})")
    assert ask("TABLE(_some_rows) PARTITION BY s ORDER BY (t), 's', 't', 5L").columns == ["s", "start", "last", "n"]
    for args, said in [("1, 'k', 't', 5L", "must be a table"), ("TABLE(_some_rows), 'k', 'u', 5L", "no column"), ("TABLE(_some_rows), 'k', 's', 5L", "whole numbers"), ("TABLE(_some_rows), 'k', 't', 0L", "above zero")]:
        with pytest.raises(Exception, match=said):
            ask(args).collect()
