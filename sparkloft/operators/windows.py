"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import table, views


def by_time() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts")


@query("""
    SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), v AS (PARTITION BY user_id ORDER BY event_type)""")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.row_number().over(by_time()).cast("long").alias("rn"), F.rank().over(by_type).cast("long").alias("rk"),
        F.dense_rank().over(by_type).cast("long").alias("dr"), F.ntile(4).over(by_time()).cast("long").alias("quarter"))


@query("""
    SELECT event_id, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)""")
def rank_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("""
    SELECT event_id, lag(value) OVER w AS before, lead(value, 2, 0.0) OVER w AS later,
      first_value(event_id) OVER w AS first, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
      nth_value(event_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("value").over(by_time()).alias("before"), F.lead("value", 2, 0.0).over(by_time()).alias("later"),
        F.first("event_id").over(by_time()).alias("first"), F.last("event_id").over(whole).alias("last"), F.nth_value("event_id", 2).over(whole).alias("second"))


@query("""
    SELECT event_id, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,4)) AS last_three
    FROM events""")
def rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(12,2)")).over(by_time().rowsBetween(-2, 0))
    return table(spark, sf_dir, "events").select("event_id", total.cast("decimal(38,4)").alias("last_three"))


@query("""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_six_hours FROM events""")
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql("""
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS in_six_hours FROM events""")


@query("""
    SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three per user; Spark limits each group before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("k", rank).where("k <= 3").select("user_id", "event_id", "value")


@query("""
    SELECT conv_id, turn, role, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
      lag(role) OVER w AS answers, coalesce(role = lag(role) OVER w, FALSE) AS repeats, CAST(sum(length(text)) OVER w AS BIGINT) AS chars_so_far FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with its place, the role before it, and what has been said so far; one window for all of a conversation."""
    w, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    before = F.lag("role").over(w)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("place"), F.count("*").over(whole).alias("turns"), before.alias("answers"),
        F.coalesce(F.col("role") == before, F.lit(False)).alias("repeats"), F.sum(F.length("text").cast("long")).over(w).alias("chars_so_far"))
