"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import table

_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


@query(f"{_A} UNION ALL {_B}")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.unionAll(b)


@query(f"{_A} UNION {_B}")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersectAll(b)


@query(f"{_A} EXCEPT ALL {_B}")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT user_id AS k FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return users.subtract(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))
