"""Hard negatives and whitening against brute force and on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloft.llm import hard_negatives, whitening

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, vector array<float>"


def brute_negatives(rows, positives=5, negatives=10):
    """rows: (id, label, vector); every product of anchors and rows."""
    rows = [(i, lab, [math.floor(256 * float(c)) for c in v]) for i, lab, v in rows
            if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, lab, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j is None, j, other) for b, (j, other, w) in enumerate(rows) if b != a]
        order = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))
        for s in [s for s in order if s[3] == lab][:positives]:
            fits = [t for t in order if t[3] != lab and 30 * -s[0] <= 100 * -t[0] <= 90 * -s[0]][:negatives]
            out += [(i, s[2], k, t[2], -s[0], -t[0]) for k, t in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_as_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    want = brute_negatives([(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows])
    got = hard_negatives.op12_hard_negatives(spark, SMALL)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(got) == want and len(want) > 50


@pytest.mark.parametrize("rows, anchors, chunk", [(16_384, 8_192, 256), (7, 2, 1)])
def test_ties_repeats_and_odd_rows(spark, rows, anchors, chunk, monkeypatch):
    """Few distinct vectors, so most scores are ties; also with tiny blocks."""
    for name, size in (("ROWS", rows), ("ANCHORS", anchors), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, size)
    r = random.Random(3)
    made = [(k * 25, r.randrange(3), [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for k in range(60)]
    made += made[:9] + [(None, 1, [0.5, 0.5, 0.5, 0.5])] * 2 + [(700, None, [1.0] * 4), (800, 1, None), (900, 1, [None, 1.0, 1.0, 1.0])]
    made += [(1000, 1, [math.nan, 1.0, 1.0, 1.0]), (1100, 2, [math.inf, 1.0, 1.0, 1.0]), (1200, 2, []), (1300, 0, [0.5, 0.5])]
    made += [(2**60 + k, k % 2, [0.75, 0.5, 0.25, 1.0]) for k in range(4)]
    df = spark.createDataFrame(made, VECTORS).withColumns({"row": F.lit(1), "asked": F.lit("x"), "rank": F.lit(2)}).repartition(5)
    assert mined(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == brute_negatives(made)


def test_negatives_of_little(spark):
    df = spark.createDataFrame([(100, 1, [1.0, 0.5]), (200, 2, [1.0, 0.25])], VECTORS)
    asked = F.col("vec_id") % 100 == 0
    assert not hard_negatives.mine(df, asked).collect()  # no other row of a label
    assert not hard_negatives.mine(df.limit(0), asked).collect()
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(100, 1, [3e18]), (101, 1, [3e18])], VECTORS), asked).collect()


def test_slices_drop_rows_and_stay_exact():
    r = np.random.default_rng(5)
    x, q = np.floor(r.normal(0, 32, (3000, 64))).astype(np.int64), np.floor(r.normal(0, 32, (6, 64))).astype(np.int64)
    seen = []

    def keep(a, at, known, low, high):
        truth = x[at] @ q[a]
        assert (low <= truth).all() and (truth <= high).all()
        seen.append(len(at))
        return high >= hard_negatives._largest(low, 5)

    for a, at, score in hard_negatives.BitSlices(x, int(np.abs(q).sum(1).max())).scores(q, slice(None), keep):
        truth = x @ q[a]
        assert (score == truth[at]).all() and set(np.argsort(-truth, kind="stable")[:5]) <= set(at) and len(at) < 10
    assert max(seen) == 3000 and sorted(seen)[len(seen) // 2] < 1500


@pytest.mark.parametrize("heaviest", [100, 2**30, 2**54])
def test_slices_of_large_numbers(heaviest):
    x = np.array([[1, -3], [5, 7], [-(2**4), 0]])
    q = np.array([[heaviest // 2, -(heaviest // 3)]])
    ((_, at, score),) = hard_negatives.BitSlices(x, int(np.abs(q).sum())).scores(q, slice(None), lambda a, at, *_: np.ones(len(at), bool))
    assert score.tolist() == [int(a) * int(q[0, 0]) + int(b) * int(q[0, 1]) for a, b in x]


def brute_whitening(rows):
    """rows: (id, vector). n, sums, falling eigenvalues, axes and the numbers of each row."""
    rows = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=float)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    return rows, len(fit), [sum(int(x) for x in c) for c in fit.T], values[::-1], axes[:, ::-1]


def test_whitening_query_as_brute_force(spark):
    made = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows, n, s, values, axes = brute_whitening([(r.vec_id, r.embedding) for r in made])
    got = {(r.vec_id, r.component): r for r in whitening.op13_whitening(spark, SMALL).collect()}
    assert len(got) == 4 * len(rows)
    signs = {}
    for i, x in rows:
        gap = [n * c - t for c, t in zip(x, s)]
        for k in range(4):
            r = got[i, k + 1]
            assert r.n == n and r.deviation == sum(g * g for g in gap)
            assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
            want = float(np.array(gap) / n @ axes[:, k] / math.sqrt(values[k]))
            sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
            assert abs(r.whitened * sign - want) < 1e-9
    z = np.array([[got[i, k].whitened for k in range(1, 5)] for i, _ in rows])  # vectors of this table are distinct
    assert np.abs(np.cov(z.T, bias=True) - np.eye(4)).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    r = random.Random(4)
    made = [(k, [r.uniform(-1, 1) for _ in range(5)]) for k in range(40)]
    made += made[:7] * 30 + [(None, made[0][1]), (90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [math.nan] * 5), (93, [-math.inf] * 5)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumns({"component": F.lit(1), "x": F.lit(2)}).repartition(40)
    got = whitening.whiten(df).collect()
    rows, n, s, values, _ = brute_whitening([(i, np.float32(v).tolist() if v and None not in v else v) for i, v in made])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and sum(r.vec_id is None for r in got) == 4
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 for r in got)


def test_whitening_of_little(spark):
    kind = "vec_id string, embedding array<double>"
    one = [("a", [1.0, 2.0, 3.0])] * 3
    for rows in ([], one, [("a", [])], [("a", None)]):
        assert not whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    flat = whitening.whiten(spark.createDataFrame([*one, ("b", [1.0, 2.0, 4.0]), ("c", [1.0])], kind)).collect()
    assert {r.component for r in flat} == {1, 2} and {r.n for r in flat} == {3} and len(flat) == 10  # three vectors span two dimensions


def test_moments_merge_as_whole():
    x = np.random.default_rng(6).normal(100, 3, (500, 6)).round(3)
    parts = [whitening.Moments.of(6) for _ in range(7)]
    for k, v in enumerate(x):
        parts[k % 7].add(v)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert whole.n == 500 and np.allclose(whole.mean, x.mean(0), rtol=1e-13) and np.allclose(whole.m / 500, np.cov(x.T, bias=True), rtol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 150])
def test_symmetric_qr(n):
    r = np.random.default_rng(n)
    for a in (r.normal(size=(n, n)), np.outer(np.arange(n), np.arange(n)), np.eye(n) * 3, np.zeros((n, n)), np.diag(r.integers(0, 3, n)).astype(float)):
        a = (a + a.T) / 2
        values, axes = whitening.symmetric_qr(a.astype(float))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, np.abs(a).max() * n))
        assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12) and np.allclose(axes * values @ axes.T, a, atol=1e-11 * max(1, np.abs(a).max() * n))
