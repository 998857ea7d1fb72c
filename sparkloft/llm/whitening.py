"""Embedding whitening: Welford's rank-one updates in each partition, the partitions' moments merged by the parallel update, and a
symmetric QR eigen-solve of the covariance.

Components become whole numbers; each distinct vector is fitted once. A task walks over its vectors and keeps count, sums, mean
and the centred products, updated by one rank-one term a vector: memory is the square of the dimension, whatever the rows. Tasks'
moments are merged by Spark in groups of FAN until FAN or fewer are left, so what the driver takes (FAN squares of the dimension) does
not grow with the input. The covariance is made tridiagonal by reflections and diagonal by shifted QR steps. Rows are then
projected in one pass. The error of the whitening is measured: the same moments, of the whitened vectors of the fit list.

Defined results: rows whose vector is null, or has a null or non-finite entry, are dropped. Shorter vectors end with zeros, as
long as the longest. Repeated rows and equal vectors count once in the fit, and each gets its result. A null id is kept. A component
without variance can't be whitened and is left out, so a single vector, equal vectors or an empty table give no row. Equal eigenvalues
leave their vectors free; any of them are returned, the same for all rows. Deviations beyond 64 bits stop the run. Only the
named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloft.llm.hard_negatives import finite
from sparkloft.sources.tables import durable, table

FAN, COMPONENTS, SCALE = 16, 4, 256
_MOMENTS = "id long, n long, s array<long>, mean array<double>, m array<double>"


def whole(vector: Column, size: int | None = None, scale: int = SCALE) -> Column:
    """floor(scale * entry) as longs; of the given size, with zeros at the end."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return x if size is None else F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))


class Moments:
    """Count, exact sums, mean and the sum of centred outer products."""

    def __init__(self, n: int, s: list[int], mean: np.ndarray, m: np.ndarray):
        self.n, self.s, self.mean, self.m = n, s, mean, m

    @classmethod
    def of(cls, size: int) -> Moments:
        return cls(0, [0] * size, np.zeros(size), np.zeros((size, size)))

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update."""
        self.n += 1
        gap = x - self.mean
        self.mean += gap / self.n
        self.m += np.multiply.outer(gap, x - self.mean)

    def merge(self, other: Moments) -> Moments:
        """The moments of both."""
        n = self.n + other.n
        gap = other.mean - self.mean
        m = self.m + other.m + np.multiply.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.s, other.s)], self.mean + gap * (other.n / n), m)

    def row(self, number: int) -> dict:
        if max(map(abs, self.s), default=0) >= 2**63:
            raise OverflowError("sums pass 64 bits")
        return {"id": number, "n": self.n, "s": self.s, "mean": self.mean.tolist(), "m": self.m.ravel().tolist()}

    @classmethod
    def read(cls, r) -> Moments:
        mean = np.array(r["mean"], float)
        return cls(int(r["n"]), [int(x) for x in r["s"]], mean, np.array(r["m"], float).reshape(len(mean), len(mean)))


def _together(rows) -> Moments:
    first, *rest = [Moments.read(r) for r in rows]
    for x in rest:
        first = first.merge(x)
    return first


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def moments(vectors: DataFrame, size: int, basis: np.ndarray | None = None, centre: np.ndarray | None = None) -> Moments | None:
    """vectors: one column of arrays of longs. Their moments, or those of (x - centre) @ basis. None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments.of(size if basis is None else basis.shape[1])
        for b in batches:
            x = _matrix(b.column(0), size)
            if basis is None:
                held.s = [a + int(c) for a, c in zip(held.s, x.sum(0))]
            for v in x.astype(float) if basis is None else (x - centre) @ basis:
                held.add(v)
        if held.n:
            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_together(rows.sort_values("id").to_dict("records")).row(int(key[0]))])

    parts = durable(vectors.mapInArrow(part, _MOMENTS))
    while parts.count() > FAN:
        parts = durable(parts.groupBy(F.floor(F.col("id") / FAN).alias("of")).applyInPandas(merged, _MOMENTS))
    left = parts.orderBy("id").collect()
    return _together(left) if left else None


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, what stands beside it, and q with a = q t q', by a reflection for each column."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if not size:
            continue
        v /= size
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: shifted QR steps on the tridiagonal form, each a chase of plane
    rotations down the block that is not yet diagonal."""
    d, e, q = tridiagonal(a)
    eps = np.finfo(float).eps
    q = np.ascontiguousarray(q.T)
    end = len(d) - 1
    while end > 0:
        if abs(e[end - 1]) <= eps * (abs(d[end - 1]) + abs(d[end])):
            e[end - 1] = 0
            end -= 1
            continue
        begin = end - 1
        while begin > 0 and abs(e[begin - 1]) > eps * (abs(d[begin - 1]) + abs(d[begin])):
            begin -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[begin] - shift, e[begin]
        for k in range(begin, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            p, g, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * g + s * s * t, s * s * p - 2 * c * s * g + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * g
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(finite(F.col("v")))
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    size = sizes["most"] or 0
    rows = rows.select("vec_id", whole(F.col("v"), None if sizes["least"] == size else size).alias("x"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = durable(rows.select("x").distinct()) if size else None
    known = moments(fit, size) if fit is not None else None
    values, axes = symmetric_qr(known.m / known.n) if known else (np.zeros(0), np.zeros((0, 0)))
    trace = values.sum()
    kept = int(np.sum(values[:components] > max(size, 1) * np.finfo(float).eps * trace))
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    n, s, share = known.n, known.s, values[:kept] / trace
    basis, centre = axes[:, :kept] / np.sqrt(values[:kept]), np.array([x / n for x in s])
    again = moments(fit, size, basis, centre)
    error = float(np.abs(again.m / again.n - np.eye(kept)).max())
    kind = to_arrow_type(rows.schema["vec_id"].dataType)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(s, object)
        for b in batches:
            x = _matrix(b.column(1), size)
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
            gaps = n * x - sums.astype(np.int64) if size * most * most < 2**63 else n * x.astype(object) - sums
            square = (gaps * gaps).sum(1)
            if len(x) and max(square) >= 2**63:
                raise OverflowError("deviations pass 64 bits")
            z = gaps.astype(float) / n @ basis
            at = np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                 pa.array(square.astype(np.int64)[at]), pa.array(z.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(at), error))],
                schema=pa.schema([("vec_id", kind), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]),
            )

    return rows.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
