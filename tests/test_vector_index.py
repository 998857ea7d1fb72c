"""The vector index: exact searches against brute force, recall of probed ones, odd vectors, hot lists, stored indexes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloft.operators import vector_index
from sparkloft.operators.vector_index import VectorIndex
from sparkloft.sources.tables import fresh_dir, table

KIND = "vec_id long, embedding array<float>"


def brute(rows, asked, k, skip=False):
    """rows, asked: (id, vector) with finite numbers."""
    size = max(len(v) for _, v in rows)
    fill = lambda v: np.float32([*v, *[0.0] * size][:size]).astype(float)
    out = set()
    for name, q in asked:
        found = sorted((-round(float(fill(q) @ fill(v)), 6), i) for i, v in rows if not (skip and i == name))
        out |= {(name, i, n) for n, (_, i) in enumerate(found[:k], 1)}
    return out


def searched(index, spark, asked, k, **more):
    got = index.search(spark.createDataFrame(asked, "query long, q array<float>"), k, **more).collect()
    return {(r["query"], r.found, r["rank"]) for r in got}


def clustered(n, clusters=20, size=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, size))
    x = centres[r.integers(0, clusters, n)] + r.normal(0, 0.15, (n, size))
    return [(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("probes", [1, 3, 100])
def test_exact_search_whatever_is_probed(spark, probes):
    rows = clustered(400)
    index = VectorIndex.build(spark.createDataFrame(rows, KIND), fresh_dir(spark, "index"))
    asked = rows[::20] + [(9999, [0.0] * 16), (9998, (-np.array(rows[3][1])).tolist())]
    assert searched(index, spark, asked, 5, probes=probes) == brute(rows, asked, 5)
    assert searched(VectorIndex(spark, index.path), spark, asked, 4, probes=probes, skip_same=True) == brute(rows, asked, 4, True)


def test_bounds_spare_lists_and_probes_find_nearly_all(spark):
    rows = clustered(3000)
    index = VectorIndex.build(spark.createDataFrame(rows, KIND), fresh_dir(spark, "index"))
    asked = spark.createDataFrame(rows[::100], "query long, q array<float>").withColumn("floor", F.lit(0.9))
    assert index._lists(asked, 4, rest=True).count() < 0.8 * 30 * len(index.n)
    want = brute(rows, rows[::100], 3, True)
    got = searched(index, spark, rows[::100], 3, probes=6, exact=False, skip_same=True)
    assert len({r[:2] for r in got} & {r[:2] for r in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, sf_dir):
    """These hardly cluster: three quarters of the lists are needed for a recall of 0.9."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(vectors, fresh_dir(spark, "index"))
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    pairs = lambda **how: {(r["query"], r.found) for r in index.search(asked, 3, skip_same=True, **how).collect()}
    want = pairs()
    assert len(pairs(probes=-(-len(index.n) * 3 // 4), exact=False) & want) >= 0.9 * len(want)


def test_odd_vectors(spark):
    rows = clustered(60, size=4) + [(7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (100, [5.0]), (101, [])]
    bad = [(None, [1.0] * 4), (200, None), (201, [1.0, None, 1.0, 1.0]), (202, [math.nan] * 4), (203, [math.inf] * 4)]
    frame = spark.createDataFrame(rows + bad, KIND).withColumns({"list": F.lit(1), "gap": F.lit("x"), "n": F.lit(2)})
    index = VectorIndex.build(frame, fresh_dir(spark, "index"), lists=5)
    asked = [(1, [1.0, 0.5, 0.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0, 1.0, 1.0, 50.0]), (4, [])]
    got = index.search(spark.createDataFrame(asked + [(5, None), (6, [math.nan] * 4), (None, [1.0])], "query long, q array<float>"), 3)
    assert sorted((r["query"], r.found, r["rank"]) for r in got.collect()) == sorted(
        (n, i, k) for n, q in asked for k, i in enumerate([i for _, i in sorted((-round(float(np.float32([*q, 0, 0, 0, 0][:4]).astype(float) @ np.float32([*v, 0, 0, 0, 0][:4]).astype(float)), 6), i) for i, v in rows)][:3], 1))
    assert VectorIndex.build(frame.limit(0), fresh_dir(spark, "index")) is None
    assert searched(index, spark, [], 3) == set()


def test_tasks_put_out_bounded_tables(spark, monkeypatch):
    """A batch of queries that ask for all lists is put out piece by piece, not as one table of queries times lists."""
    rows = clustered(3000)
    index = VectorIndex.build(spark.createDataFrame(rows, KIND), fresh_dir(spark, "index"))
    asked, made = spark.createDataFrame(rows, "query long, q array<float>").withColumn("floor", F.lit(None).cast("double")), []
    with monkeypatch.context() as m:
        m.setattr(vector_index, "durable", lambda frame: frame)
        m.setattr(type(asked), "mapInPandas", lambda self, how, schema: made.append(how) or self)
        index._lists(asked, len(index.n))
    tables = [len(b) for b in made[0](iter([asked.toPandas()]))]
    assert sum(tables) == 3000 * sum(n > 0 for n in index.n) and max(tables) <= 140_000
    monkeypatch.setattr(vector_index, "CELLS", 100)
    few = VectorIndex.build(spark.createDataFrame(rows[:400], KIND), fresh_dir(spark, "index"))
    assert searched(few, spark, rows[:400:20], 5) == brute(rows[:400], rows[:400:20], 5)


def test_hot_list_in_blocks(spark, monkeypatch):
    """A third of the vectors are one; lists and queries are cut into small blocks."""
    monkeypatch.setattr(vector_index, "CHUNK", 50)
    monkeypatch.setattr(vector_index, "QUERIES", 4)
    rows = clustered(300) + [(k, [1.0] + [0.0] * 15) for k in range(1000, 1150)]
    index = VectorIndex.build(spark.createDataFrame(rows, KIND), fresh_dir(spark, "index"))
    asked = rows[::15]
    assert searched(index, spark, asked, 4, skip_same=True) == brute(rows, asked, 4, True)
