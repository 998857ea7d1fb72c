"""Queries over times give the same rows in any zone of the session, also where clocks are changed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloft.functions.times import instant, micros, unzoned
from sparkloft.operators.joins import as_of, range_join
from sparkloft.plans import catalog
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"
TIMED = [n for n, sql in catalog.ORACLE_SQL.items() if "ts" in sql.replace("(", " ").replace(",", " ").replace(")", " ").split() or "date" in sql]


@pytest.fixture(params=["America/New_York", "Australia/Lord_Howe"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", TIMED)
def test_query_elsewhere(spark, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert compare(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL) > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def changed(spark, column):
    """A row for every half hour around a change of clocks."""
    begin = F.lit("2024-03-09 12:00:00.000007").cast("timestamp_ntz")
    return spark.range(100).select("id", F.lit("u").alias("k"), (begin + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id") * 30)).alias(column))


def test_times_are_counted_as_they_stand(spark, zone):
    rows = changed(spark, "ts")
    got = rows.select("id", micros(rows, "ts").alias("at"), (unzoned(instant(F.col("ts"))) == F.col("ts")).alias("same")).orderBy("id").collect()
    assert all(r.same and r["at"] - got[0]["at"] == r.id * 1_800_000_000 for r in got)
    old = spark.sql("SELECT timestamp_ntz'1905-02-03 04:05:06.789012' AS ts")
    assert old.select(unzoned(instant(F.col("ts"))) == F.col("ts")).first()[0]


def test_range_and_as_of_joins(spark, zone):
    a, b = changed(spark, "a"), changed(spark, "b").withColumnRenamed("id", "j")
    pairs = {(r.id, r.j) for r in range_join(a, b, ["k"], "a", "b", "5 hours").collect()}
    assert pairs == {(i, j) for i in range(100) for j in range(100) if 0 < j - i <= 10}
    right = changed(spark, "ts").where("id % 7 = 0").withColumn("v", F.col("id")).drop("id")
    got = as_of(changed(spark, "ts"), right, "k", "ts", "v", "1 hour").collect()
    assert all(r.v == r.id // 7 * 7 for r in got)
