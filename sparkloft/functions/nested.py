"""Arrays, maps, structs and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import table


@query("""
    SELECT vec_id, len(embedding) AS size, embedding[2:4] AS part, len(list_filter(embedding, lambda x: x > 0)) AS positive,
      len(list_filter(embedding, lambda x: x > 0.5)) > 0 AS any_large, embedding[100] AS beyond FROM embeddings""")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("size"), F.slice(e, 2, 3).alias("part"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.exists(e, lambda x: x > 0.5).alias("any_large"), F.try_element_at(e, F.lit(100)).alias("beyond"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, added as doubles from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@query("""
    SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings""")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


@query("""
    SELECT vec_id, i - 1 AS at, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def explode_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return rows.withColumn("at", F.col("at").cast("long"))


@query("""
    SELECT r_regionkey, array_to_string(list_transform(list_sort(names, 'ASC', 'NULLS LAST'), lambda x: coalesce(x, '<null>')), '|') AS last,
      array_to_string(list_transform(list_sort(names, 'ASC', 'NULLS FIRST'), lambda x: coalesce(x, '<null>')), '|') AS first,
      array_to_string(list_transform(list_sort(names, 'DESC', 'NULLS LAST'), lambda x: coalesce(x, '<null>')), '|') AS falling
    FROM (SELECT r_regionkey, [r_name, nullif(r_name, 'ASIA'), 'M'] AS names FROM region)""")
def array_sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """array_sort puts nulls last; sort_array first, or last if it falls. array_join is given a word for them."""
    names = F.array("r_name", F.nullif("r_name", F.lit("ASIA")), F.lit("M"))
    ways = {"last": F.array_sort(names), "first": F.sort_array(names), "falling": F.sort_array(names, asc=False)}
    return table(spark, sf_dir, "region").select("r_regionkey", *[F.array_join(x, "|", "<null>").alias(n) for n, x in ways.items()])


@query("""
    SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS keys, sum(n_nationkey) AS total FROM nation GROUP BY 1""")
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map per region from nation to key, and what its keys and values hold."""
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return grouped.select("n_regionkey", F.size("m").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), total.alias("total"))


@query("SELECT r_regionkey, r_name AS label, r_regionkey * 2 AS twice FROM region")
def structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(F.col("r_name").alias("label"), (F.col("r_regionkey") * 2).alias("twice"))
    return table(spark, sf_dir, "region").select("r_regionkey", s.alias("s")).select("r_regionkey", "s.label", "s.twice")


@query("""
    SELECT event_id, json_extract_string(props, '$.k') AS raw, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"), F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT r_regionkey, '{"key":' || r_regionkey || ',"name":"' || r_name || '"}' AS json FROM region""")
def json_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("json"))
