"""Recursion over tables: reachability by a semi-naive fixpoint, and chains by pointer doubling.

Spark's WITH RECURSIVE joins all rows found in a step with the table and keeps no account of rows already seen, so a cycle never
ends. Here a step joins only the rows that are new (the frontier), takes away what earlier steps have found, and stops when a frontier
is empty. Small frontiers are sent to the links; for others links are shuffled. Every step is stored in the shared folder: lineage stays
short, and as both sides of each join are stored, Spark can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloft.functions.times import micros
from sparkloft.operators.basics import money
from sparkloft.plans.registry import query
from sparkloft.sources.tables import durable, fresh_dir, table, views

#: Stored levels are joined into one after so many steps.
COMPACT = 16
#: A frontier of at most so many nodes is sent to the links, which are not shuffled then.
FEW = 500_000


def reachable(links: DataFrame, seeds: DataFrame, src: str, dst: str, node: str = "node") -> DataFrame:
    """node and steps (long): every node that can be reached from a seed, and the least number of links to it; seeds take none.

    Links with a null end lead nowhere; repeated links, loops and cycles change nothing, but every step reads them. Null seeds don't count."""
    spark, path = links.sparkSession, fresh_dir(links.sparkSession, "links")
    links = links.select(F.col(src).alias("_from"), F.col(dst).alias(node)).where(f"_from is not null and {node} is not null")
    links.write.parquet(path)  # columns: read in each step
    links = spark.read.schema(links.schema).parquet(path)
    frontier = durable(seeds.select(F.col(node).alias(node)).where(F.col(node).isNotNull()).distinct())
    levels, steps = [frontier.withColumn("steps", F.lit(0).cast("long"))], 0
    while n := frontier.count():
        steps += 1
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        if len(levels) >= COMPACT:
            seen = durable(seen)
            levels = [seen]
        begun = frontier.withColumnRenamed(node, "_from")
        met = links.join(F.broadcast(begun) if n <= FEW else begun, "_from", "left_semi").select(node).distinct()
        frontier = durable(met.join(seen, node, "left_anti"))
        levels.append(frontier.withColumn("steps", F.lit(steps).cast("long")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def chains(rows: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """node, root, hops (long) and total for rows that have at most one parent each: the end of the chain of parents, the number of
    links to it, and the sum of `value` (a decimal) from the node to the root, both included.

    Pointers are doubled: each round joins every unfinished row with the row its pointer stands at, so a chain of n links takes log2(n)
    rounds, not n. A null parent, or one that is no node, ends a chain. Nodes on a cycle, or leading into one, have a null root, hops and
    total. Nodes must be unique and not null; null values count as zero."""
    kind = "decimal(38,2)"
    every = durable(rows.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(value), F.lit(0)).cast(kind).alias("own")))
    parents = every.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    begun = every.join(parents, "parent", "left").select(
        "node", "own", F.when(F.col("known"), F.col("parent")).alias("at"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("hops"))
    # total: the nodes from this one to the one before `at`; of roots nothing
    state = durable(begun.select("node", F.coalesce("at", "node").alias("at"), "hops", F.when(F.col("hops") > 0, F.col("own")).otherwise(0).cast(kind).alias("total")))
    n, span = state.count(), 1
    ended, moving = state.where("hops = 0"), state.where("hops > 0")
    while span <= 2 * n and not moving.isEmpty():
        # rows that have ended stay as targets: pointers may stand at them
        ahead = moving.unionByName(ended).select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("total").alias("_total"))
        further = moving.join(ahead, "at").select(
            "node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("total") + F.col("_total")).cast(kind).alias("total"), (F.col("_hops") == 0).alias("done"))
        moved = durable(further)
        ended, moving = ended.unionByName(moved.where("done").drop("done")), moved.where("not done").drop("done")
        span *= 2
    roots = every.select(F.col("node").alias("at"), F.col("own").alias("_own"))
    found = ended.join(roots, "at").select("node", F.col("at").alias("root"), "hops", (F.col("total") + F.col("_own")).cast(kind).alias("total"))
    return every.select("node").join(found, "node", "left")


@query("""
    WITH RECURSIVE ends AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
      links AS (SELECT a, b FROM ends UNION ALL SELECT b, a FROM ends),
      reach(node, steps) AS (SELECT 's' || s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)
        UNION SELECT b, steps + 1 FROM reach JOIN links ON node = a WHERE steps < 6)
    SELECT node, min(steps) AS steps FROM reach GROUP BY node""")
def recursive_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the supplier with the largest balance to the parts it supplies, their other suppliers, and so on."""
    suppliers = table(spark, sf_dir, "supplier")
    richest = suppliers.agg(F.max("s_acctbal").alias("s_acctbal"))
    seeds = suppliers.join(F.broadcast(richest), "s_acctbal").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    supplied = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ends = supplied.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    links = ends.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return reachable(links, seeds, "a", "b")


def with_previous(orders: DataFrame, days: int) -> DataFrame:
    """`previous`: the order of the same customer just before, if it is at most so many days older. A customer's orders are cut into bins of
    that length, so one with very many is not one window: what went before is in the own bin, or the last of the bin before."""
    width = days * 86_400_000_000
    at = micros(orders, "o_orderdate")
    rows = durable(orders.withColumns({"_at": at, "_bin": F.floor(at / F.lit(width))}))
    inside = Window.partitionBy("o_custkey", "_bin").orderBy("_at", "o_orderkey")
    last = rows.groupBy("o_custkey", "_bin").agg(F.max(F.struct("_at", "o_orderkey")).alias("_end"))
    last = durable(last.select("o_custkey", (F.col("_bin") + 1).alias("_bin"), "_end"))
    before = rows.withColumn("_own", F.lag(F.struct("_at", "o_orderkey")).over(inside)).join(last, ["o_custkey", "_bin"], "left")
    near = F.coalesce("_own", "_end")
    return before.withColumn("previous", F.when(F.col("_at") - near["_at"] <= width, near["o_orderkey"])).drop("_at", "_bin", "_own", "_end")


@query("""
    WITH RECURSIVE placed AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderdate, lag(o_orderkey) OVER w AS earlier, lag(o_orderdate) OVER w AS earlier_date
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
      linked AS (SELECT o_orderkey, price, CASE WHEN o_orderdate - earlier_date <= INTERVAL 365 DAY THEN earlier END AS parent FROM placed),
      chain(o_orderkey, first_order, hops, total) AS (SELECT o_orderkey, o_orderkey, CAST(0 AS BIGINT), CAST(price AS DECIMAL(38,2)) FROM linked WHERE parent IS NULL
        UNION ALL SELECT l.o_orderkey, first_order, hops + 1, CAST(total + l.price AS DECIMAL(38,2)) FROM chain c JOIN linked l ON l.parent = c.o_orderkey)
    SELECT o_orderkey, first_order, hops, CAST(total AS DECIMAL(38,4)) AS total FROM chain""")
def recursive_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order in the run of its customer's orders that are at most a year apart: the run's first order, the place in it, and what has
    been paid up to it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", money("o_totalprice").alias("price"))
    found = chains(with_previous(orders, 365), "o_orderkey", "previous", "price")
    return found.select(F.col("node").alias("o_orderkey"), F.col("root").alias("first_order"), "hops", F.col("total").cast("decimal(38,4)").alias("total"))


@query("""
    WITH RECURSIVE months(m, last) AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders
      UNION ALL SELECT CAST(m + INTERVAL 1 MONTH AS DATE), last FROM months WHERE m + INTERVAL 1 MONTH <= last)
    SELECT m AS month, count(o_orderkey) AS orders FROM months LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = m GROUP BY 1""")
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar from the first order to the last, made by recursion in SQL, with the orders of each month; months without orders too."""
    views(spark, sf_dir, "orders")
    return spark.sql("""
        WITH RECURSIVE months(m, last) AS (SELECT trunc(min(o_orderdate), 'MM'), CAST(max(o_orderdate) AS DATE) FROM orders
          UNION ALL SELECT add_months(m, 1), last FROM months WHERE add_months(m, 1) <= last)
        SELECT m AS month, count(o_orderkey) AS orders FROM months LEFT JOIN orders ON trunc(o_orderdate, 'MM') = m GROUP BY m""")
