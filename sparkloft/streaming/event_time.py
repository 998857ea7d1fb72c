"""Event-time windows over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.functions.times import has_zone, unzoned
from sparkloft.plans.registry import query
from sparkloft.sources.tables import table

TUMBLING = "SELECT date_trunc('hour', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS total FROM events GROUP BY 1"
SLIDING = """
    SELECT start, count(*) AS n FROM (
      SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS start FROM events, (VALUES (0), (1)) t(s)) GROUP BY 1"""
SESSIONS = """
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (
      SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
        SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events))
    GROUP BY user_id, session"""


def _plain(events: DataFrame, c: Column) -> Column:
    """Stored times have no zone and windows take them as they are; a stream's are instants, which go back."""
    return unzoned(c) if has_zone(events, "ts") else c


def tumbling_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(38,4)").alias("total")).select(
        _plain(events, F.col("w.start")).alias("start"), "n", "total")


def sliding_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour", "30 minutes")
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(_plain(events, F.col("w.start")).alias("start"), "n")


def session_counts(events: DataFrame) -> DataFrame:
    w = F.session_window("ts", "6 hours")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select(
        "user_id", _plain(events, F.col("w.start")).alias("start"), _plain(events, F.col("last")).alias("last"), "n")


@query(TUMBLING)
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events"))


@query(SLIDING)
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_counts(table(spark, sf_dir, "events"))


@query(SESSIONS)
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session ends six hours after its last event; an event at that very time begins another."""
    return session_counts(table(spark, sf_dir, "events"))
