"""Joins: equi, outer, semi, anti, null-aware, theta, range, as-of, lateral and correlated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloft.functions.times import micros
from sparkloft.plans.registry import query
from sparkloft.sources.tables import durable, table, views


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_name", "o_totalprice")


@query("""
    SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger side is summed by its key before the join, on the partitioning that the join needs."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, n_chars, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "full").select("doc_id", "n_chars", "quality")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(large, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_in_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN is true only if no key on the right is null; so an anti join, dropped whole if there is one."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return not_in(docs, labels, "doc_id")


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left rows whose key is NOT IN right's, with SQL's nulls: none if right has a null key; a null key on the left only
    if right is empty. Spark's own null-aware join broadcasts the right side; this one doesn't have to."""
    state = right.agg(F.count("*").alias("_n"), F.count(key).alias("_known"))
    kept = left.join(right.where(F.col(key).isNotNull()).select(key), key, "left_anti").crossJoin(F.broadcast(state))
    return kept.where((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(key).isNotNull())).drop("_n", "_known")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)")
def exists_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "lineitem")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)")


_NULLED = """(SELECT nullif({k}, 0) AS k, {v} AS {v} FROM {t})"""


@query(f"""
    SELECT n_name, r_name FROM {_NULLED.format(k='n_regionkey', v='n_name', t='nation')} a
    JOIN {_NULLED.format(k='r_regionkey', v='r_name', t='region')} b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(0)).alias("a"), "n_name")
    b = table(spark, sf_dir, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("b"), "r_name")
    return a.join(b, F.col("a").eqNullSafe(F.col("b"))).select("n_name", "r_name")


@query(f"""
    SELECT n_name, r_name FROM {_NULLED.format(k='n_regionkey', v='n_name', t='nation')} a
    FULL JOIN {_NULLED.format(k='r_regionkey', v='r_name', t='region')} b ON a.k = b.k""")
def full_join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(0)).alias("a"), "n_name")
    b = table(spark, sf_dir, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("b"), "r_name")
    return a.join(b, F.col("a") == F.col("b"), "full").select("n_name", "r_name")


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables of fixed size."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by an inequality alone, which no shuffle can bring together: both tables have a fixed size, one is broadcast."""
    regions = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT a.s_suppkey AS low, count(*) AS above FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal GROUP BY 1")
def larger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers have a larger balance. The condition is an inequality, but only its count is asked for: a
    running count over balances replaces the pairs."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("low"), "s_acctbal")
    above = running_count(suppliers.groupBy("s_acctbal").agg(F.count("*").alias("n")), "s_acctbal", "n")
    return suppliers.join(above.where("above > 0"), "s_acctbal").select("low", "above")


def running_count(rows: DataFrame, order: str, n: str) -> DataFrame:
    """`above`: the sum of n over rows with a larger `order`. Rows are dealt to ranges; a window runs in each range, and the
    ranges' sums, one row each, are added."""
    ranged = durable(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.sum(n).alias("_n"))
    after = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    more = parts.select("_part", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_more"))
    own = F.coalesce(F.sum(n).over(inside), F.lit(0))
    return ranged.withColumn("_own", own).join(F.broadcast(more), "_part").withColumn("above", F.col("_own") + F.col("_more")).drop("_part", "_own", "_more")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, width: str) -> DataFrame:
    """Pairs of equal keys with left_ts < right_ts <= left_ts + width. Time is cut into bins of that width: a left row meets
    its own bin and the next, so the join has an equality on the bin and does not grow with a key's history."""
    size = _seconds(width)
    bin_of = lambda at: F.floor(F.col(at) / F.lit(size * 1_000_000))
    a = left.withColumn("_left", micros(left, left_ts)).withColumn("_bin", F.explode(F.array(bin_of("_left"), bin_of("_left") + 1)))
    b = right.withColumn("_right", micros(right, right_ts)).withColumn("_bin", bin_of("_right"))
    later = F.col("_right") - F.col("_left")
    return a.join(b, [*keys, "_bin"]).where((later > 0) & (later <= size * 1_000_000)).drop("_bin", "_left", "_right")


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


@query("""
    SELECT a.event_id AS view_id, b.event_id AS buy_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
    WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seen = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("bought"))
    return range_join(seen, bought, ["user_id"], "seen", "bought", "6 hours").select("view_id", "buy_id")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, bin_width: str = "1 day") -> DataFrame:
    """For every left row the latest right `value` of its key at or before its `ts`; null if none. Of right rows at one time
    the largest value counts; a right row at the same time as a left row counts for it. Null keys and values on the right
    meet nothing.

    Both sides are merged and a window carries the last value on, so work does not grow with pairs. The window is of a key
    and a bin of time, so a key with a third of all rows is split; what a bin inherits comes from one row for each bin.
    """
    names, width = left.columns, _seconds(bin_width) * 1_000_000
    known = right.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, ts, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None)}).unionByName(known, allowMissingColumns=True)
    both = both.withColumn("_bin", F.floor(micros(both, ts) / F.lit(width)))
    order = F.when(F.col("_value").isNotNull(), F.struct(ts, "_value"))
    ends = both.groupBy(key, "_bin").agg(F.max_by("_value", order).alias("_end"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_key"), F.col("_bin").alias("_of"), F.last("_end", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(key, "_bin").orderBy(ts, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_value", ignorenulls=True).over(inside)).where("_side = 1")
    joined = carried.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bin").eqNullSafe(F.col("_of")), "left")
    return joined.select(*names, F.coalesce("_last", "_before").alias(value))


@query("""
    SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return as_of(clicks, bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("""
    SELECT r_name, n_name FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k
    FROM region JOIN nation ON n_regionkey = r_regionkey) WHERE k <= 2""")
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "region", "nation")
    return spark.sql("""
        SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 2)""")


@query("""
    SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def scalar_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders near their customer's largest: the subquery is a window maximum, without a second scan."""
    most: Column = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", most.alias("most"))
    return rows.where(F.col("o_totalprice") > F.col("most") * 0.95).select("o_orderkey")
