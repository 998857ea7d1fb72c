"""Sketches that are stored and merged: distinct counts (HyperLogLog) and quantiles (KLL).

Finest groups are sketched once; coarser ones merge the stored sketches, of a few kilobytes each, instead of reading rows again. No
group's values meet in one task: sketches are made in the map stage and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import durable, fresh_dir, table

#: log2 of HLL's buckets (standard error 1.04 / 2**(LG / 2), here 1.6 %) and KLL's size (its stated error of rank, one side: 1.33 %).
LG, KLL = 12, 200
USERS_WITHIN, RANK_WITHIN = 0.05, 0.03


def store(rows: DataFrame, keys: list[str], item: str, value: str, path: str) -> DataFrame:
    """A row for each group: keys, n, items (HLL of `item`), value_sketch (KLL of `value`), kept in a folder."""
    made = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, LG).alias("items"), F.kll_sketch_agg_double(F.col(value), KLL).alias("values"))
    made.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of every level of the rollup, merged from the stored ones: keys, level (how many keys are all), n, items, values."""
    levels = sketches.rollup(*keys).agg(F.grouping_id().alias("_id"), F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))
    return levels.withColumn("level", F.bit_count("_id").cast("long")).drop("_id")


def estimates(sketches: DataFrame) -> DataFrame:
    """With users (distinct items) and middle (median), both estimated."""
    middle = F.kll_sketch_get_quantile_double("values", F.lit(0.5))
    return sketches.withColumns({"users": F.hll_sketch_estimate("items"), "middle": middle}).drop("items", "values")


@query("""
    SELECT event_type, CAST(ts AS DATE) AS day, CAST(grouping(event_type) + grouping(CAST(ts AS DATE)) AS BIGINT) AS level, count(*) AS n, count(DISTINCT user_id) AS users,
      TRUE AS users_within, TRUE AS middle_within FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))""")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact users of each day and type, of each type, and of all, and whether the merged sketches are within their bounds: users by five
    per cent, and the median's rank by three per cent of the rows."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), "user_id", "value")
    keys = ["event_type", "day"]
    told = durable(estimates(rolled_up(store(events, keys, "user_id", "value", fresh_dir(spark, "sketches")), keys)))
    of = lambda level, *by: told.where(F.col("level") == level).select(*by, F.col("middle").alias(f"m{level}"))
    middles = durable(of(0, *keys).join(of(1, "event_type"), "event_type").crossJoin(of(2)))  # the last is one row
    around = [f(c).alias(f"{n}{k}") for k in range(3) for n, f, c in (("below", F.count_if, F.col("value") < F.col(f"m{k}")), ("upto", F.count_if, F.col("value") <= F.col(f"m{k}")))]
    ranks = events.join(middles, keys).groupBy(*keys).agg(*around)
    ranks = durable(ranks).rollup(*keys).agg(F.bit_count(F.grouping_id()).cast("long").alias("level"), *[F.sum(f"{n}{k}").alias(f"{n}{k}") for k in range(3) for n in ("below", "upto")])
    exact = events.rollup(*keys).agg(F.bit_count(F.grouping_id()).cast("long").alias("level"), F.countDistinct("user_id").alias("exact"))
    a, b, c = told.alias("a"), exact.alias("b"), ranks.alias("c")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "level")]).join(c, [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "level")])
    below, upto = (F.when(F.col("a.level") == 0, F.col(f"{n}0")).when(F.col("a.level") == 1, F.col(f"{n}1")).otherwise(F.col(f"{n}2")) for n in ("below", "upto"))
    n, slack = F.col("a.n"), F.col("a.n") * RANK_WITHIN + 1
    return both.select(
        "a.event_type", "a.day", "a.level", "a.n", F.col("exact").alias("users"), (F.abs(F.col("a.users") - F.col("exact")) <= F.col("exact") * USERS_WITHIN).alias("users_within"),
        ((below <= n / 2 + slack) & (upto >= n / 2 - slack)).alias("middle_within"))
