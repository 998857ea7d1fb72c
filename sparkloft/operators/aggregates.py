"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloft.operators.basics import money
from sparkloft.plans.registry import query
from sparkloft.sources.tables import durable, table, views


@query("""
    SELECT l_shipmode_key AS flag, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS qty, count(*) AS n, round(avg(l_quantity), 4) AS mean
    FROM (SELECT l_returnflag AS l_shipmode_key, l_quantity FROM lineitem) GROUP BY 1""")
def group_sum_avg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.sum(money("l_quantity")).cast("decimal(38,4)").alias("qty"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("""
    SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT (user_id, CAST(ts AS DATE))) AS user_days FROM events GROUP BY 1""")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", F.col("ts").cast("date")).alias("user_days"))


@query("""
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 100) AS large FROM events GROUP BY 1""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 100).alias("large"))


_CUBED = """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS all_flags, CAST(grouping(l_linestatus) AS BIGINT) AS all_states,
    count(*) AS n FROM lineitem GROUP BY {} """


def _counted(rows) -> DataFrame:
    return rows.agg(F.grouping("l_returnflag").cast("long").alias("all_flags"), F.grouping("l_linestatus").cast("long").alias("all_states"), F.count("*").alias("n"))


@query(_CUBED.format("ROLLUP (l_returnflag, l_linestatus)"))
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(_CUBED.format("CUBE (l_returnflag, l_linestatus)"))
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(_CUBED.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    return _counted(table(spark, sf_dir, "lineitem").groupingSets([[flag], [state], []], flag, state))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("""
    SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_pop(value), 3) AS var,
      round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 4) AS skew FROM events GROUP BY 1""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness of the population."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.var_pop("value"), 3).alias("var"), F.round(F.skewness("value"), 4).alias("skew"))


@query("""
    SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_pop(l_quantity, l_extendedprice), 2) AS covar,
      round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1""")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.covar_pop("l_quantity", "l_extendedprice"), 2).alias("covar"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("""
    SELECT event_type, round(median(value), 4) AS mid, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY 1""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(table(spark, sf_dir, "events"), "event_type", "value", {"mid": 0.5, "p90": 0.9})
    return found.select("event_type", F.round("mid", 4).alias("mid"), F.round("p90", 4).alias("p90"))


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (between two values in proportion) of each group. Spark's own functions keep a group's values in one
    task; here distinct values are counted, dealt to ranges of group and value, and picked by their rank. Nulls don't count."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    ranged = durable(counted.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(group, "_part").agg(F.sum("_n").alias("_held"))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(parts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.sum("_held").over(whole).alias("_all"), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_to", F.sum("_n").over(inside)).join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    last = F.col("_to") + F.col("_before")

    def at(rank: Column) -> Column:
        return F.max(F.when((last - F.col("_n") <= rank) & (rank < last), F.col(value)))

    out = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * share
        part = F.max(place - F.floor(place))
        out.append((at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part).alias(name))
    return placed.groupBy(group).agg(*out)


@query("""
    SELECT user_id, min(value) AS least, max_by(event_id, ts) AS last_event, min_by(event_id, ts) AS first_event FROM events GROUP BY 1""")
def max_by_min_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("value").alias("least"), F.max_by("event_id", "ts").alias("last_event"), F.min_by("event_id", "ts").alias("first_event"))


@query("""
    SELECT o_orderstatus, o_orderpriority AS commonest FROM (SELECT o_orderstatus, o_orderpriority,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1""")
def mode_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value; of equally common ones the smallest."""
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    most = counted.groupBy("o_orderstatus").agg(F.min(F.struct((-F.col("n")).alias("n"), "o_orderpriority")).alias("m"))
    return most.select("o_orderstatus", F.col("m.o_orderpriority").alias("commonest"))


@query("SELECT toxic, bool_and(quality = 1) AS all_good, bool_or(quality = 0) AS any_bad FROM labels GROUP BY 1")
def bool_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("toxic").agg(
        F.bool_and(F.col("quality") == 1).alias("all_good"), F.bool_or(F.col("quality") == 0).alias("any_bad"))


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY 1")
def collect_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
def string_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")


@query("""
    SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low
    FROM orders GROUP BY 1""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("o_orderkey"))
    return wide.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).cast("long").alias("urgent"), F.coalesce("5-LOW", F.lit(0)).cast("long").alias("low"))


@query("""
    SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS value FROM customer
    UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return rows.unpivot("c_custkey", ["c_acctbal", "c_nationkey"], "name", "value")


@query("""
    SELECT CAST(least(greatest(floor(value / 50) + 1, 0), 11) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.width_bucket("value", F.lit(0.0), F.lit(500.0), F.lit(10)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT sum(l_quantity) AS s, avg(l_quantity) AS a, count(*) AS n, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
def empty_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity < 0").agg(
        F.sum("l_quantity").alias("s"), F.avg("l_quantity").alias("a"), F.count("*").alias("n"), F.max("l_quantity").alias("m"))


@query("SELECT TRUE AS users_within, TRUE AS events_within, TRUE AS median_within")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches differ between engines; what is compared is that they keep their stated error against exact values."""
    e = table(spark, sf_dir, "events")
    middle = quantiles(e.select(F.lit(0).alias("all"), "value"), "all", "value", {"low": 0.49, "high": 0.51})
    # distinct counts by themselves: beside them Spark would carry the sketches' buffers along with every distinct value
    found = e.agg(
        F.approx_count_distinct("user_id", 0.02).alias("u"), F.approx_count_distinct("event_id", 0.02).alias("e"),
        F.percentile_approx("value", 0.5, 1000).alias("m"))
    users, events = (e.select(c).distinct().agg(F.count(c).alias(n)) for c, n in (("user_id", "users"), ("event_id", "events")))
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b)  # noqa: E731  five standard errors
    return found.crossJoin(users).crossJoin(events).crossJoin(middle).select(  # a row each
                        within("u", "users").alias("users_within"), within("e", "events").alias("events_within"),
                        F.col("m").between(F.col("low"), F.col("high")).alias("median_within"))


@query("""
    SELECT round((n * s4 - 4 * s3 * s1 + 6 * s2 * s1 * s1 / n - 3 * s1 * s1 * s1 * s1 / n / n) / ((s2 - s1 * s1 / n) * (s2 - s1 * s1 / n)) - 3, 3) AS kurtosis
    FROM (SELECT count(*) AS n, sum(value) AS s1, sum(value ** 2) AS s2, sum(value ** 3) AS s3, sum(value ** 4) AS s4 FROM events)""")
def kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess kurtosis of the population."""
    return table(spark, sf_dir, "events").agg(F.round(F.kurtosis("value"), 3).alias("kurtosis"))
