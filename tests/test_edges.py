"""Nulls, ties, empty tables and late rows, which the test tables lack."""

import datetime as dt

from pyspark.sql import functions as F

from sparkloft.operators.aggregates import quantiles
from sparkloft.operators.basics import numbered
from sparkloft.operators.joins import as_of, not_in, range_join, running_count
from sparkloft.sources.formats import round_trip
from sparkloft.streaming.event_time import tumbling_counts
from sparkloft.streaming.streams import LATENESS, run_to_end

T = dt.datetime(2024, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = lambda *rows: spark.createDataFrame([(x,) for x in rows], "k long")
    assert [r.k for r in not_in(left, right(2), "k").collect()] == [1]
    assert not_in(left, right(2, None), "k").count() == 0
    assert not_in(left, right(), "k").count() == 3


def test_as_of_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(10)), (3, "b", at(1)), (4, "a", at(5))], "id long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 7), ("a", at(5), 9), ("a", at(11), 8)], "k string, ts timestamp_ntz, v long")
    assert {r.id: r.v for r in as_of(left, right, "k", "ts", "v").collect()} == {1: 9, 2: 9, 3: None, 4: 9}
    assert as_of(left.limit(0), right, "k", "ts", "v").count() == 0
    odd = spark.createDataFrame([(5, None, at(9)), (6, "a", None), (7, "a", at(4000)), (8, "a", at(9))], left.schema)
    more = right.unionByName(spark.createDataFrame([(None, at(1), 1), ("a", at(8), None), ("a", None, 3)], right.schema))
    got = {r.id: r.v for r in as_of(odd, more, "k", "ts", "v").collect()}
    assert got[5] is None and got[7] == 8 and got[8] == 9


def test_range_join_bounds(spark):
    a = spark.createDataFrame([("u", at(0), 1), ("u", at(59), 2), (None, at(0), 3)], "k string, a timestamp_ntz, i long")
    b = spark.createDataFrame([("u", at(60), 1), ("u", at(0), 2), ("u", at(61), 3), (None, at(1), 4)], "k string, b timestamp_ntz, j long")
    got = {(r.i, r.j) for r in range_join(a, b, ["k"], "a", "b", "1 hour").collect()}
    assert got == {(1, 1), (2, 1), (2, 3)}


def test_running_count(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.lit(1).cast("long").alias("n"))
    assert all(r.above == 499 - r.x for r in running_count(rows, "x", "n").collect())


def test_quantiles_of_odd_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), (None, 1.0), (None, 4.0), ("c", None)]
    got = {r.g: (r.q25, r.mid, r.top) for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q25": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    assert got == {"a": (1.75, 2.0, 10.0), "b": (5.0, 5.0, 5.0), None: (1.75, 2.5, 4.0)}


def test_numbered_in_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.nullif(F.col("id") % 3, F.lit(0)).alias("s"))
    got = numbered(rows, F.col("s").asc_nulls_first(), F.col("x").desc()).collect()
    assert [r.row for r in got] == list(range(1, 1001))
    assert [(r.s, r.x) for r in got] == sorted(((r.s, r.x) for r in got), key=lambda p: (p[0] is not None, p[0] or 0, -p[1]))


def test_formats_keep_nulls_and_empty_strings(spark):
    rows = spark.createDataFrame([(1, None, at(1)), (2, "", None), (3, 'a,"b"\n', at(2)), (None, "x", at(3))], "i long, s string, t timestamp_ntz")
    for kind in ("parquet", "json", "csv", "orc"):
        options = {"multiLine": "true"} if kind == "csv" else {}
        got = round_trip(rows if not options else rows.where("s is null or s not like '%b%'"), kind)
        want = rows if not options else rows.where("s is null or s not like '%b%'")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, kind


def test_late_rows_are_dropped(spark, tmp_path):
    """A late row falls out one batch after the watermark has passed it."""
    schema = "ts timestamp, value double"
    batches = [[at(10), at(70)], [at(300)], [at(310)], [at(20)]]
    for k, rows in enumerate(batches):
        path = f"{tmp_path}/in/{k}"
        spark.createDataFrame([(t, 1.0) for t in rows], schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run_to_end(tumbling_counts(stream.withWatermark("ts", LATENESS)))
    assert {r.start.hour: r.n for r in got.collect()} == {0: 1, 1: 1}
