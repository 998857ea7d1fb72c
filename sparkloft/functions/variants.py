"""VARIANT: JSON documents of mixed shape parsed once, then read by path and type, taken apart, and described."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.plans.registry import query
from sparkloft.sources.tables import table

# Documents whose shape depends on the event: objects in objects, arrays of mixed kinds, a number or a text under one name, a bare
# text, and something that is no JSON. The same text in both engines.
_K = "CAST({k} AS {text})"
_SHAPES = """CASE event_type
      WHEN 'click' THEN '{{"k":' || {k} || ',"user":{{"id":' || {user} || ',"new":' || CASE WHEN {user} % 2 = 0 THEN 'true' ELSE 'false' END || '}}}}'
      WHEN 'view' THEN '{{"k":"v' || {k} || '","tags":[' || {k} || ',"t' || {user} || '",null]}}'
      WHEN 'purchase' THEN CASE WHEN {user} % 2 = 0 THEN '{{"k":' || {k} || ',"gift":null}}' ELSE '{{"k":"odd"}}' END
      WHEN 'signup' THEN '"user ' || {user} || '"'
      ELSE '{{"k":' || {k} || ',' END"""
SPARK_DOC = _SHAPES.format(k="CAST(get_json_object(props, '$.k') AS STRING)", user="user_id")
DUCK_DOC = _SHAPES.format(k="json_extract_string(props, '$.k')", user="user_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type and the document as VARIANT; null where it is no JSON."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(SPARK_DOC).alias("doc")).withColumn("v", F.try_parse_json("doc"))


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'OBJECT<k: BIGINT>' AS shape, json_extract(props, '$.none') IS NULL AS lacks FROM events""")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, sf_dir, "events").select(
        "event_id", F.variant_get(v, "$.k", "long").alias("k"), F.schema_of_variant(v).alias("shape"), F.variant_get(v, "$.none", "long").isNull().alias("lacks"))


@query(f"""
    WITH docs AS (SELECT event_id, event_type, doc, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS j FROM (SELECT *, {DUCK_DOC} AS doc FROM events))
    SELECT event_id, try_cast(json_extract_string(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.k') AS k_text, CAST(json_extract_string(j, '$.user.id') AS BIGINT) AS user_id,
      CAST(json_extract(j, '$.user.new') AS BOOLEAN) AS new, json_extract_string(j, '$.tags[1]') AS tag, json_type(j, '$.gift') = 'NULL' AS no_gift,
      CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') END AS bare, j IS NULL AS broken FROM docs""")
def variant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into documents of several shapes. A path that is not there, or a value that can't be of the type asked for, gives null."""
    v = F.col("v")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return documents(spark, sf_dir).select(
        "event_id", get("$.k", "long").alias("k"), get("$.k", "string").alias("k_text"), get("$.user.id", "long").alias("user_id"), get("$.user.new", "boolean").alias("new"),
        get("$.tags[1]", "string").alias("tag"), F.when(F.try_variant_get(v, "$.gift", "variant").isNotNull(), F.is_variant_null(F.try_variant_get(v, "$.gift", "variant"))).alias("no_gift"),
        F.when(F.schema_of_variant(v) == "STRING", get("$", "string")).alias("bare"), v.isNull().alias("broken"))


@query(f"""
    WITH docs AS (SELECT event_id, doc FROM (SELECT *, {DUCK_DOC} AS doc FROM events) WHERE json_valid(doc) AND json_type(doc) = 'OBJECT')
    SELECT event_id, key, CAST(value AS VARCHAR) AS json FROM docs, json_each(docs.doc) e(key, value)""".replace("json_each(docs.doc) e(key, value)", "LATERAL (SELECT key, value FROM json_each(docs.doc))"))
def variant_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects taken apart into keys and values, which are written as JSON again."""
    objects = documents(spark, sf_dir).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    objects.createOrReplaceTempView("_objects")
    return spark.sql("SELECT event_id, key, to_json(value) AS json FROM _objects, LATERAL variant_explode(v)")


@query(f"""
    WITH docs AS (SELECT event_type, doc FROM (SELECT *, {DUCK_DOC} AS doc FROM events) WHERE json_valid(doc) AND json_type(doc) = 'OBJECT'),
      entries AS (SELECT event_type, e.key, e.type FROM docs, LATERAL (SELECT key, type FROM json_each(docs.doc)) e),
      kinds AS (SELECT event_type, key, list_sort(list(DISTINCT CASE type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID'
        WHEN 'OBJECT' THEN 'OBJECT<id: BIGINT, new: BOOLEAN>' WHEN 'ARRAY' THEN 'ARRAY<VARIANT>' ELSE type END)) AS found FROM entries GROUP BY ALL)
    SELECT event_type, 'OBJECT<' || string_agg(key || ': ' || CASE WHEN len(found) = 1 THEN found[1] ELSE 'VARIANT' END, ', ' ORDER BY key) || '>' AS shape FROM kinds GROUP BY 1""")
def variant_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape that fits all documents of a group: what differs among them is VARIANT."""
    objects = documents(spark, sf_dir).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    return objects.groupBy("event_type").agg(F.schema_of_variant_agg("v").alias("shape"))
