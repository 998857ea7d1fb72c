"""File formats: each query writes a table to the shared folder and returns what is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import fresh_dir, table

#: Options under which a format gives back nulls and empty strings as they were.
OPTIONS = {"csv": {"header": "true", "nullValue": "<null>"}, "json": {"ignoreNullFields": "false"}, "parquet": {}, "orc": {}}


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """The rows, written in a format and read with their own schema (none is inferred)."""
    path = fresh_dir(df.sparkSession, f"format-{kind}")
    df.write.format(kind).options(**OPTIONS[kind]).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).options(**OPTIONS[kind]).load(path)


_ORDERS = "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_totalprice, o_orderdate FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_totalprice", "o_orderdate")


@query(_ORDERS)
def format_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "parquet")


@query(_ORDERS)
def format_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "json")


@query(_ORDERS)
def format_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "csv")


@query(_ORDERS)
def format_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "orc")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders by status: the filter picks folders, so other files are not opened."""
    path = fresh_dir(spark, "partitioned")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority")
