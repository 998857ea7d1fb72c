"""The surface for users' functions: scalar, vectorised, aggregate, table and grouped ones. Bodies are simple, so that
plain SQL gives the same rows; where a built-in function does the work, it is the better choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.functions.partial_states import PartialAggregate, aggregated
from sparkloft.plans.registry import query
from sparkloft.sources.tables import table


@query("SELECT p_partkey, 'size ' || p_size AS label FROM part")
def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.udf(lambda n: None if n is None else f"size {n}", "string", useArrow=True)
    return table(spark, sf_dir, "part").select("p_partkey", label("p_size").alias("label"))


@query("SELECT p_partkey, round(p_retailprice * 1.1, 4) AS taxed FROM part")
def pandas_scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def taxed(x: pd.Series) -> pd.Series:
        return x * 1.1

    return table(spark, sf_dir, "part").select("p_partkey", F.round(taxed("p_retailprice"), 4).alias("taxed"))


@query("SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY 1")
def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate by states that are merged: five event types, none of them in one worker."""
    found = aggregated(table(spark, sf_dir, "events"), ["event_type"], "value", Spread(), "spread")
    return found.select("event_type", F.round("spread", 4).alias("spread"))


class Spread(PartialAggregate):
    """The largest value less the smallest."""

    def start(self) -> np.ndarray:
        return np.array([np.inf, -np.inf])

    def add(self, state: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.array([values.min(initial=state[0]), values.max(initial=state[1])])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([min(a[0], b[0]), max(a[1], b[1])])

    def finish(self, state: np.ndarray) -> float | None:
        return float(state[1] - state[0]) if state[0] <= state[1] else None


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for word in (text or "").split(" "):
                yield (word,)

    spark.udtf.register("words_of", Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word FROM part, LATERAL words_of(p_name)")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS nth FROM events")
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """applyInPandas; for groups of bounded size."""

    def number(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts")
        return b[["user_id", "event_id"]].assign(nth=range(1, len(b) + 1))

    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(number, "user_id long, event_id long, nth long")


@query("SELECT doc_id FROM documents WHERE n_chars > 2000")
def map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def long_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[b["n_chars"] > 2000, ["doc_id"]]

    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").mapInPandas(long_ones, "doc_id long")


@query("SELECT doc_id, n_chars * 2 AS twice FROM documents")
def map_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2)], names=["doc_id", "twice"])

    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").mapInArrow(twice, "doc_id long, twice long")


@query("""
    SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are counted before they meet, so a group holds a row of each."""

    def counts(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [int(a["n"].sum())], "suppliers": [int(b["n"].sum())]})

    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).groupBy("k")
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).groupBy("k")
    return a.cogroup(b).applyInPandas(counts, "k int, customers long, suppliers long")
