"""Merged states and sketches: hot groups, null keys and values, empty tables; documents of any shape."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkloft.functions import partial_states
from sparkloft.functions.partial_states import aggregated
from sparkloft.functions.udfs import Spread
from sparkloft.operators.aggregates import approximate_aggregates
from sparkloft.operators.sketches import estimates, rolled_up, store
from sparkloft.sources.tables import fresh_dir


@pytest.mark.parametrize("most_keys", [1, 10_000])
def test_hot_group_and_nulls(spark, most_keys, monkeypatch):
    """Four fifths of the rows in one group; keys of two columns with nulls and numbers that doubles can't hold."""
    monkeypatch.setattr(partial_states, "MOST_KEYS", most_keys)
    r = random.Random(1)
    rows = [(2**60 + 1, "hot", r.random()) for _ in range(4000)] + [(r.choice([None, 2**60 + 3]), r.choice(["a", None]), r.choice([None, r.random()])) for _ in range(1000)]
    rows += [(5, "none", None), (6, "one", 2.5)]
    want = {}
    for a, b, v in rows:
        want.setdefault((a, b), []).extend([] if v is None else [v])
    frame = spark.createDataFrame(rows, "a long, b string, v double").withColumns({"_task": F.lit(1), "_state": F.lit("x")}).repartition(16)
    got = {(x.a, x.b): x.s for x in aggregated(frame, ["a", "b"], "v", Spread(), "s").collect()}
    assert got == {k: max(v) - min(v) if v else None for k, v in want.items()}
    assert aggregated(frame.limit(0), ["a"], "v", Spread(), "s").count() == 0


def test_values_of_other_kinds(spark):
    rows = spark.createDataFrame([(1, 3), (1, 9), (2, None)], "k int, v int")
    assert {x.k: x.s for x in aggregated(rows, ["k"], "v", Spread(), "s").collect()} == {1: 6.0, 2: None}


def test_states_are_few_however_hot_a_group(spark):
    """What is shuffled is a state for each task and key."""
    rows = spark.range(20_000).select(F.lit("all").alias("k"), F.col("id").cast("double").alias("v")).repartition(8)
    assert aggregated(rows, ["k"], "v", Spread(), "s").first().s == 19_999
    plan = aggregated(rows, ["k"], "v", Spread(), "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("FlatMapGroupsInArrow")  # states are made below the grouping


def test_sketches_are_added_and_merged(spark):
    """Two days stored one after the other; a hot group; values of which most are equal."""
    path = fresh_dir(spark, "sketches")
    day = lambda d, lo, hi: spark.range(lo, hi).select(F.lit(d).alias("day"), F.when(F.col("id") % 5 > 0, "hot").otherwise("cold").alias("kind"), "id", (F.col("id") % 7).cast("double").alias("v"))
    store(day("mo", 0, 20_000), ["kind", "day"], "id", "v", path)
    kept = store(day("tu", 10_000, 30_000), ["kind", "day"], "id", "v", path)
    got = {(r.kind, r.day): r for r in estimates(rolled_up(kept, ["kind", "day"])).collect()}
    assert {k: r.level for k, r in got.items()} == {("hot", "mo"): 0, ("hot", "tu"): 0, ("cold", "mo"): 0, ("cold", "tu"): 0, ("hot", None): 1, ("cold", None): 1, (None, None): 2}
    assert got[None, None].n == 40_000 and abs(got[None, None].users - 30_000) < 1_500 and got[None, None].middle == 3
    assert abs(got["hot", None].users - 24_000) < 1_200 and abs(got["cold", "tu"].users - 4_000) < 200
    assert estimates(rolled_up(kept.limit(0), ["kind", "day"])).count() <= 1


def test_sketches_are_not_grouped_by_distinct_values(spark, tmp_path):
    """A sketch's buffer is kept once a task, not once for each distinct value; nulls are no value; empty tables."""
    rows = spark.range(5_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 900).alias("user_id"), (F.col("id") % 100).cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = approximate_aggregates(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(True, True, True)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert approximate_aggregates(spark, str(tmp_path)).count() <= 1


def test_documents_of_any_shape(spark):
    docs = ['{"a": 1}', '{"a": 1.5}', '{"a": "x", "b": [1, {"c": null}]}', "[]", "null", "", None, "{", '{"a": 12345678901234567890}', "7", '"t"', '{"a": true}']
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "i int, d string").withColumn("v", F.try_parse_json("d"))
    got = {r.i: r for r in rows.select("i", F.try_variant_get("v", "$.a", "long").alias("a"), F.try_variant_get("v", "$.a", "decimal(20,0)").alias("big"), F.is_variant_null("v").alias("none"), F.col("v").isNull().alias("broken"), F.schema_of_variant("v").alias("shape")).collect()}
    assert [got[k].a for k in (0, 1, 2, 8, 11)] == [1, 1, None, None, 1] and got[8].big == Decimal(12345678901234567890)
    assert [k for k in got if got[k].broken] == [5, 6, 7] and [k for k in got if got[k].none] == [4]
    assert got[2].shape == "OBJECT<a: STRING, b: ARRAY<VARIANT>>" and got[9].shape == "BIGINT"
