"""Exact duplicates: rows are grouped by a 128-bit hash of their content, the bytes inside each group are compared, and one row of
each group of equal texts stays: the smallest id, or first the largest of a given preference.

Rows are reduced to (id, hash) before anything is grouped; counts and keepers are grouped minima, found in the map stage, so a text
with a third of all rows sends one row per task. Bytes are compared as the key of such a grouping too: of texts whose hash repeats,
each task sends every distinct one once. If a hash turns out to stand for several texts, its rows are grouped by the text itself.
The join that brings results back to rows has two stored sides, so Spark can split a hot group.

Defined results: null text counts as empty, and empty texts are one group. Texts are equal if they are without white space
([\\x20\\x09-\\x0D]). Of rows equal in preference and id one stays; null ids come last. A null preference comes last. Repeated rows count
each. Very long texts are read whole. An empty table gives no row. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.sources.tables import durable, table

#: Up to so many repeated hashes (16 bytes each) are sent to every task, to leave out texts that no other can equal.
BROADCAST_HASHES = 500_000


def normalised(text: Column) -> Column:
    """The text without white space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(body: Column) -> Column:
    return F.unhex(F.md5(body))


def _decided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: doc_id, prefer, row, text_sha256 and the keys that make texts equal."""
    order = F.struct(F.col("prefer").isNull().alias("bare"), (-F.col("prefer")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = durable(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(order).alias("first")))
    first = groups.select(*keys, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    return rows.join(first, keys).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefer: Column | None = None, digest: Callable[[Column], Column] = content_hash, most_broadcast: int = BROADCAST_HASHES
) -> DataFrame:
    """For each row doc_id, keep_id (the row that stays), group_size, kept and text_sha256. prefer: a number, the largest stays."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(0) if prefer is None else prefer).alias("prefer"), normalised(F.col(text)).alias("body"))
    texts = texts.withColumn("hash", digest(F.col("body")))
    texts = texts.withColumn("text_sha256", F.sha2("body", 256))
    numbered = lambda rows: durable(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = numbered(texts.drop("body"))
    repeated = durable(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    bodies = texts.select("hash", "body")
    if repeated.count() <= most_broadcast:
        bodies = bodies.join(F.broadcast(repeated), "hash", "left_semi")
    shared = durable(bodies.distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    if shared.isEmpty():
        return _decided(rows, ["hash"])
    apart = numbered(texts.join(shared, "hash", "left_semi"))
    return _decided(rows.join(shared, "hash", "left_anti"), ["hash"]).unionByName(_decided(apart, ["hash", "body"]))


def dropped_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns, for tables whose ids are unique."""
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col("_kept")), "left_semi")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    length = F.length(F.coalesce("text", F.lit("")))
    return exact_groups(table(spark, sf_dir, "documents"), prefer=length)
