"""Scans, projections, filters, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import durable, table


def money(name: str):
    """Sums of doubles depend on their order; those of decimals don't."""
    return F.col(name).cast("decimal(12,2)")


@query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS sum_qty,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS sum_price,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DECIMAL(38,4)) AS sum_disc_price,
      count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by flag and status: one scan of seven columns, one shuffle of a few partial sums."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("decimal(38,4)").alias("sum_qty"),
        F.sum(money("l_extendedprice")).cast("decimal(38,4)").alias("sum_price"),
        F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(38,4)").alias("sum_disc_price"),
        F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", net.alias("net"))


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band,
      nullif(o_orderstatus, 'F') AS open_status, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status FROM orders""")
def case_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, status = F.col("o_totalprice"), F.nullif("o_orderstatus", F.lit("F"))
    band = F.when(price > 300000, "high").when(price > 100000, "middle").otherwise("low")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", band.alias("band"), status.alias("open_status"), F.coalesce(status, F.lit("done")).alias("status"))


@query("""
    SELECT p_partkey, p_name FROM part
    WHERE p_size BETWEEN 5 AND 45 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') AND p_name LIKE '%widget%'""")
def filter_between_in_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = F.col("p_size").between(5, 45) & F.col("p_brand").isin(*(f"Brand#{k}" for k in range(1, 6))) & F.col("p_name").like("%widget%")
    return table(spark, sf_dir, "part").where(fits).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 25 largest: each task keeps 25 rows."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page of a report."""
    rows = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.offset(15).limit(10).select("o_orderkey", "o_totalprice")


def numbered(rows: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """The rows sorted, with their place from 1. Rows are dealt to ranges and sorted in each; a row's place is its place in its
    range, and what the ranges before hold, one number each, is added. So no task gets all rows, and they are shuffled once."""
    ranged = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # how that function counts: 2**33 for each range
    held = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    before = held.select("_part", before.alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, inside + F.col("_before") + 1).drop("_part", "_before", "_at")


@query("""
    SELECT o_orderkey, s, row_number() OVER (ORDER BY s ASC NULLS FIRST, o_orderkey) AS row FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)""")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return numbered(rows, F.col("s").asc_nulls_first(), F.col("o_orderkey").asc())


@query("""
    SELECT o_orderkey, s, row_number() OVER (ORDER BY s DESC NULLS LAST, o_orderkey) AS row FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)""")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return numbered(rows, F.col("s").desc_nulls_last(), F.col("o_orderkey").asc())


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()
