"""Structured Streaming over the events file. Every query reads it as a stream, runs until all is read, and returns the
sink's rows. Results go to Parquet in the shared folder (append) or by batch (update), with a checkpoint beside them, so
a stream that broke off goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloft.functions.times import instant
from sparkloft.plans.registry import query
from sparkloft.sources.tables import fresh_dir, table
from sparkloft.streaming.event_time import session_counts, sliding_counts, tumbling_counts

LATENESS = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream with a watermark."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", LATENESS)


def run_to_end(stream: DataFrame, mode: str = "append", place: tuple[str, str] | None = None) -> DataFrame:
    """What the stream puts out until its input is used up, however long that takes. In complete mode the last batch is the
    result. place: folders of the result and the checkpoint, new ones if not given; a stream that has them goes on there."""
    spark = stream.sparkSession
    path, state = place or (fresh_dir(spark, "stream"), fresh_dir(spark, "stream-state"))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").option("path", path).start()
    else:
        started = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(path)).start()
    try:
        started.awaitTermination()
    finally:
        started.stop()
    return spark.read.schema(stream.schema).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession, empty_batches: bool = True):
    """State stores that custom state needs. State that expires by the clock asks for batches without data for ever; where all input is
    read and the stream then ends, they are turned off."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower(),
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _closed(sql: str, length: str) -> str:
    """The windows that the final watermark has closed."""
    return f"SELECT * FROM ({sql}) WHERE start + INTERVAL {length} <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("""
    SELECT start, n, total FROM (SELECT date_trunc('hour', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS total FROM events GROUP BY 1)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(tumbling_counts(event_stream(spark, sf_dir)))


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS total FROM events GROUP BY 1")
def stream_tumbling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(tumbling_counts(event_stream(spark, sf_dir)), "complete")


@query(_closed("""
    SELECT start, count(*) AS n FROM (
      SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS start FROM events, (VALUES (0), (1)) t(s)) GROUP BY 1""", "1 HOUR"))
def stream_sliding_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(sliding_counts(event_stream(spark, sf_dir)))


@query("""
    SELECT user_id, start, last, n FROM (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (
      SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
        SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events))
    GROUP BY user_id, session) WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(session_counts(event_stream(spark, sf_dir)))


@query("SELECT event_id, user_id, value FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice. Repeats of an id within the watermark are dropped; the state forgets ids that are older."""
    twice = event_stream(spark, sf_dir).union(event_stream(spark, sf_dir))
    once = twice.dropDuplicatesWithinWatermark(["event_id"])
    return run_to_end(once.select("event_id", "user_id", "value"))


@query("""
    SELECT a.event_id AS signup_id, b.event_id AS error_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'signup' AND b.event_type = 'error'""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_stream(spark, sf_dir).where("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("event_id").alias("signup_id"), F.col("ts").alias("signed"))
    b = event_stream(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("failed"))
    near = (F.col("u") == F.col("user_id")) & (F.col("failed") > F.col("signed")) & (F.col("failed") <= F.col("signed") + F.expr("interval 1 hour"))
    return run_to_end(a.join(b, near).select("signup_id", "error_id"))


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return run_to_end(event_stream(spark, sf_dir).join(customers, "user_id").select("event_id", "c_mktsegment"))


@query("""
    WITH known AS (SELECT max(ts) FILTER (WHERE event_type <> 'error') - INTERVAL 10 MINUTE AS before, max(ts) - INTERVAL 10 MINUTE AS after FROM events)
    SELECT date_trunc('hour', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS total FROM events, known
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= after AND (event_type <> 'error' OR date_trunc('hour', ts) + INTERVAL 1 HOUR > before) GROUP BY 1""")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are reported when all other events have been read and the stream has stopped. It goes on from its checkpoint and
    drops those whose window the watermark had closed."""
    events, arrived = table(spark, sf_dir, "events"), fresh_dir(spark, "arrived")
    place = fresh_dir(spark, "stream"), fresh_dir(spark, "stream-state")
    for part in ("event_type != 'error'", "event_type = 'error'"):
        events.where(part).write.mode("append").parquet(arrived)
        rows = spark.readStream.schema(events.schema).parquet(arrived).withColumn("ts", instant(F.col("ts"))).withWatermark("ts", LATENESS)
        out = run_to_end(tumbling_counts(rows), place=place)
    return out


class Totals(StatefulProcessor):
    """Per user the number of events and the largest value so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, most double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, most = self.seen.get() or (0, float("-inf"))
        for b in rows:
            n, most = n + len(b), max(most, float(b["value"].max()))
        self.seen.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    def close(self) -> None:
        pass


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def stream_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transformWithStateInPandas; each batch puts out its users' totals so far, the last of them counts."""
    with rocksdb(spark):
        grouped = event_stream(spark, sf_dir).select("user_id", "value").groupBy("user_id")
        out = grouped.transformWithStateInPandas(Totals(), "user_id long, n long, most double", "Append", "None")
        return run_to_end(out).groupBy("user_id").agg(F.max("n").alias("n"), F.max("most").alias("most"))
