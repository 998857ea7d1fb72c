"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

Each document's statistics (shares of letters, capitals, symbols, repeats; lengths of words and lines) are computed once
by vectorised Python over Arrow batches and kept in the shared folder. Random Fourier features approximate a Gaussian
kernel on them. Every partition of labelled rows sums its part of the normal equations; the sums, whose size depends on
the number of features alone, are added by Spark and solved on the driver. Two folds give scores that no row's own label
has shaped; from their histogram, of at most BINS rows, pool-adjacent-violators makes the calibration.

Labelled rows are all used; no sample. Defined results: null text counts as empty; empty texts have statistics (zeros)
and a score like others. Null labels and labels of unknown documents are ignored. Without any label of use every score is
0.5. Repeated documents are scored each; a repeated label counts each time, a label of a repeated id for each of its texts. A null
doc_id is scored and never joined to a label. Very long texts are read whole. An empty table of documents gives no score. Only
the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.llm.batches import filled
from sparkloft.sources.tables import durable, table

FEATURES, BANDWIDTH, RIDGE, BINS, SEED = 192, 4.0, 1e-3, 512, 7
_SYMBOLS = frozenset("*$%&#!|@^~<>{}[]\\=+_")
_CLASSES = np.zeros((5, 256))
for _i in range(256):
    _c = chr(_i)
    _CLASSES[0, _i] = _i >= 128 or _c.isalpha()
    _CLASSES[1, _i] = _i < 128 and _c.isupper()
    _CLASSES[2, _i] = _i < 128 and _c.isdigit()
    _CLASSES[3, _i] = _c in _SYMBOLS
    _CLASSES[4, _i] = _c in ".,;:?\"'()-"
N_STATS = 21


def doc_stats(text: str) -> list[float]:
    """The statistics of one text; all zero if it is empty."""
    words = text.split()
    if not words:
        return [0.0] * N_STATS
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = float(raw.sum())
    letters, upper, digits, symbols, stops = _CLASSES @ raw
    n = len(words)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    sizes = np.fromiter(map(len, words), float, n)
    pairs = len(set(zip(lower, lower[1:]))) if n > 1 else 1
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, lines), float, len(lines))
    return [
        np.log1p(len(text)), letters / size, upper / max(letters, 1), digits / size, symbols / size, stops / size,
        raw[10] / size, np.log1p(n), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        np.log1p(len(counts)) / np.log1p(n), len(counts) / n, max(counts.values()) / n, pairs / max(n - 1, 1),
        sum(map(str.__eq__, lower, lower[1:])) / n, sum(w[-1] in _SYMBOLS for w in words) / n,
        sum(len(w) > 1 and w.isupper() for w in words) / n, sum(w[0].isupper() for w in words) / n,
        np.log1p(lengths.mean()), len(set(lines)) / len(lines),
    ]


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and stats (array of doubles) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "stats": [[float(x) for x in doc_stats(t or "")] for t in b["body"]]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def projection(n_stats: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.normal(0, 1 / BANDWIDTH, (n_stats, features)), r.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, shift: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """One row of random Fourier features, after a constant, for each row of statistics."""
    w, b = projection(x.shape[1], features, seed)
    z = np.cos(np.clip((x - shift) / scale, -6, 6) @ w + b) * np.sqrt(2 / features)
    return np.hstack([np.ones((len(x), 1)), z])


def normal_equations(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, features: int) -> dict[int, np.ndarray]:
    """rows: stats, y, fold. For each fold the sum of z (z, y)': a task sends one row for each of its rows, and Spark adds them up
    as they come."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in filled(batches):
            z = fourier(np.vstack(b["stats"]), shift, scale, features)
            zy = np.hstack([z, b["y"].to_numpy()[:, None]])
            for fold in b["fold"].unique():
                at = (b["fold"] == fold).to_numpy()
                sums[fold] = sums.get(fold, 0) + z[at].T @ zy[at]
        for fold, s in sums.items():
            yield pd.DataFrame({"fold": fold, "i": range(len(s)), "v": list(s)})

    parts = rows.mapInPandas(part, "fold int, i int, v array<double>")
    added = parts.groupBy("fold", "i").agg(F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(features + 2)]).alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in added:
        out.setdefault(r["fold"], np.zeros((features + 1, features + 2)))[r["i"]] = r["v"]
    return out


def ridge(eq: np.ndarray, penalty: float = RIDGE) -> np.ndarray:
    a = eq[:, :-1] + np.diag([1e-9] + [penalty * max(eq[0, 0], 1)] * (len(eq) - 1))
    return np.linalg.solve(a, eq[:, -1])


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: x ascending, n rows and their sum y at each; knots of a rising curve. Each level is drawn
    to the overall share by two pseudo rows, so that it is never quite 0 or 1."""
    share = y.sum() / n.sum()
    blocks: list[list[float]] = []
    for at, k, s in zip(x, n, y):
        blocks.append([at * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return [b[0] / b[1] for b in blocks], [(b[2] + 2 * share) / (b[1] + 2) for b in blocks]


class Model:
    """The fitted classifier; a few kilobytes."""

    def __init__(self, shift, scale, weights, knots, features):
        self.shift, self.scale, self.weights, self.knots, self.features = shift, scale, weights, knots, features

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier(stats, self.shift, self.scale, self.features) @ self.weights
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES) -> Model | None:
    """stats: doc_id, stats; labels: doc_id, y (0 or 1). None if no label is of use."""
    rows = stats.join(labels.where("y is not null").select("doc_id", F.col("y").cast("double").alias("y")), "doc_id")
    rows = rows.select("stats", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int").alias("fold"))
    rows = durable(rows)
    wide = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    known = rows.agg(F.count("*").alias("n"), *wide).first()
    if not known["n"]:
        return None
    shift = np.array([known[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([known[f"s{i}"] for i in range(N_STATS)]) + 1e-6
    eq = normal_equations(rows, shift, scale, features)
    total = sum(eq.values())
    others = {fold: ridge(total - eq[fold] if len(eq) > 1 else total) for fold in eq}

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            z = fourier(np.vstack(b["stats"]), shift, scale, features)
            raw = np.zeros(len(b))
            for fold, w in others.items():
                at = (b["fold"] == fold).to_numpy()
                raw[at] = z[at] @ w
            at = np.clip(np.round((raw + 0.5) * BINS / 2), 0, BINS)
            yield pd.DataFrame({"bin": at, "n": 1.0, "y": b["y"]}).groupby("bin", as_index=False).sum()

    hist = rows.mapInPandas(bins, "bin double, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    h = hist.toPandas().sort_values("bin")
    knots = isotonic(h["bin"].to_numpy() * 2 / BINS - 0.5, h["n"].to_numpy(), h["y"].to_numpy())
    return Model(shift, scale, ridge(total), knots, features)


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of statistics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            found = model.score(np.vstack(b["stats"])) if model and len(b) else 0.5
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": found})

    return stats.mapInPandas(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the row is kept from training: crc32 of the id as text has the remainder `fold`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = durable(statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    model = fit(stats, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    return score(stats, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
