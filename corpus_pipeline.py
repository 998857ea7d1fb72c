"""From raw documents to packed token sequences: quality, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`, others
that `docs` has besides included, whatever their names.

Defined results, for every stage: null text counts as empty and stays null; very long texts are read whole; an empty table
gives an empty one. Rows are judged each by its own text, also where an id is repeated or null. Of equal rows near-duplicate
removal keeps one; the other stages treat them alike. Of a group of near-duplicates that row stays whose id is smallest (null
last; of several texts with that id the one whose shingle set has the smallest name).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.llm import decontaminate, packing, quality, secret_scans, simhash
from sparkloft.sources.tables import durable, fresh_dir, table

#: Lists of ids of at most so many rows (of 8 bytes), and lists of findings, are broadcast; longer ones are joined by shuffle.
BROADCAST_IDS, BROADCAST_FINDINGS = 2_000_000, 200_000


def _bounded(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows in the shared folder, marked for broadcast if their counted number allows it."""
    rows = durable(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column has."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (name + "_" * k for k in range(1, len(taken) + 2)) if n.lower() not in taken) for name in names]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, does not reject. It scores texts where they are read; only
    the statistics of labelled documents are joined with labels. The ids of labels are broadcast to pick those documents;
    where they are too many for that, statistics are made of all."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    ids = durable(labels.select("doc_id").distinct())
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else docs
    model = quality.fit(durable(quality.statistics(labelled)), labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([quality.doc_stats(t or "") for t in texts]).reshape(-1, quality.N_STATS)) >= 0.5)

    return docs.where(kept(F.coalesce("text", F.lit(""))))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8). Ids all of whose rows go are dropped by
    id alone; rows of ids that are null, or repeated with a row that stays, are told apart by the names of their shingle sets."""
    sets = durable(simhash.similar_sets(docs.select("doc_id", "text")))
    sets = durable(sets.groupBy("doc_id", "key", "root").agg(F.count("*").alias("rows")))
    first = durable(sets.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    judged = durable(sets.join(first, "root").select("doc_id", "key", "rows", stays.alias("stays")))
    ids = durable(judged.groupBy("doc_id").agg(F.bool_or("stays").alias("some"), F.sum("rows").alias("rows")))
    single = "doc_id is not null and some and rows = 1"
    out = docs.where("doc_id is not null").join(_bounded(ids.where(f"not ({single}) and doc_id is not null").select("doc_id")), "doc_id", "left_anti")
    mixed = ids.where(f"some and not ({single})").select("doc_id")
    if mixed.isEmpty():
        return out
    key, their_id, their_key = _free(docs, "key", "their_id", "their_key")
    listed = _bounded(mixed.withColumnRenamed("doc_id", their_id))
    named = docs.join(listed, F.col("doc_id").eqNullSafe(F.col(their_id)), "left_semi").withColumn(key, simhash.set_name(F.col("text")))
    kept = durable(judged.where("stays").select(F.col("doc_id").alias(their_id), F.col("key").alias(their_key)).join(
        mixed.withColumnRenamed("doc_id", "_id"), F.col(their_id).eqNullSafe(F.col("_id")), "left_semi"))
    found = named.join(kept, F.col("doc_id").eqNullSafe(F.col(their_id)) & (F.col(key) == F.col(their_key)), "left_semi")
    return out.unionByName(found.dropDuplicates(["doc_id", key]).drop(key).select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Leaks are named by their text, so rows that share an id are judged each."""
    found = decontaminate.leaks_by_text(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    name, = _free(docs, "text_id")
    leaked = _bounded(found.select(F.col("text_id").alias(name)).distinct())
    return docs.withColumn(name, decontaminate.text_id(F.col("text"))).join(leaked, name, "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    found = secret_scans.scan_incremental(docs.select("doc_id", "text"), fresh_dir(spark, "secret-ledger"))
    blob, name, cuts, blocks = _free(docs, "blob", "their_blob", "cuts", "blocks")
    found = found.where(F.size("cuts") > 0).select(F.col("blob").alias(name), F.col("cuts").alias(cuts)).dropDuplicates([name])
    named = docs.withColumn(blob, secret_scans.blob_of(F.col("text")))
    joined = named.join(_bounded(found, BROADCAST_FINDINGS), F.col(blob) == F.col(name), "left")
    cut = F.col(cuts).isNotNull()
    laid = joined.withColumn(blocks, F.when(cut, secret_scans.blocks_of(F.col("text"))))
    clean = laid.withColumn("text", F.when(cut, secret_scans.redact(F.col(blocks), F.col(cuts))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences."""
    import public_tokenizers

    path = public_tokenizers.path
    return packing.with_digest(packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fingerprints, fitted models and packing are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None
