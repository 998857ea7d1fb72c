"""A table function with a table argument: the caller names the table, how it is partitioned and in what order rows come; the function
says by analyze() which columns it gives for that table, and walks over each partition with a few numbers of state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sparkloft.functions.times import micros, stood
from sparkloft.plans.registry import query
from sparkloft.sources.tables import table
from sparkloft.streaming.event_time import SESSIONS

DAY, GAP = 86_400_000_000, 6 * 3_600_000_000


class Sessions:
    """sessions_of(TABLE(t) PARTITION BY key ORDER BY (at), 'key', 'at', gap): a row for each run of rows less than gap apart, with the key as it
    is in t. Rows with a null time belong to no session."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table: TABLE(...)")
        for name in (key, at):
            if not name.isConstantExpression or name.value not in rows.dataType.names:
                raise ValueError(f"{name.value!r} is no column of the table; it has {', '.join(rows.dataType.names)}")
        if not isinstance(rows.dataType[at.value].dataType, IntegralType):
            raise ValueError(f"{at.value} must hold whole numbers")
        if not gap.isConstantExpression or gap.value is None or gap.value <= 0:
            raise ValueError("the gap must be a constant above zero")
        numbers = [StructField(name, LongType()) for name in ("start", "last", "n")]
        return AnalyzeResult(StructType([StructField(key.value, rows.dataType[key.value].dataType), *numbers]))

    def __init__(self):
        self.open: list | None = None

    def eval(self, row: Row, key: str, at: str, gap: int) -> Iterator[tuple]:
        t = row[at]
        if t is None:
            return
        if self.open and t < self.open[2] + gap:
            self.open[2], self.open[3] = t, self.open[3] + 1
        else:
            if self.open:
                yield tuple(self.open)
            self.open = [row[key], t, t, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield tuple(self.open)


def sessions(rows: DataFrame, gap: int = GAP, piece: int = DAY) -> DataFrame:
    """rows: user_id and `at` (microseconds). Sessions of each user: user_id, start, last, n. A user's rows are walked over in pieces of time, so one
    with very many is not one task; the pieces' sessions, a few each, are then joined where less than the gap is between them."""
    spark = rows.sparkSession
    spark.udtf.register("sessions_of", F.udtf(Sessions))
    rows.select("user_id", "at", F.floor(F.col("at") / piece).alias("piece")).createOrReplaceTempView("_session_rows")
    parts = spark.sql(f"SELECT * FROM sessions_of(TABLE(_session_rows) PARTITION BY (user_id, piece) ORDER BY (at), 'user_id', 'at', {int(gap)}L)")
    each = Window.partitionBy("user_id").orderBy("start")
    begins = F.when(F.col("start") < F.lag("last").over(each) + gap, 0).otherwise(1)
    numbered = parts.withColumn("_begins", begins).withColumn("_no", F.sum("_begins").over(each))
    return numbered.groupBy("user_id", "_no").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_no")


@query(SESSIONS)
def table_argument_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = sessions(events.select("user_id", micros(events, "ts").alias("at")))
    return found.select("user_id", stood(F.col("start")).alias("start"), stood(F.col("last")).alias("last"), "n")
