"""Hard negatives by bit-sliced integer products.

Components are whole numbers. A block of rows is kept as bit-planes; planes are multiplied by the anchors from the most
significant on. What the planes still to come can add lies between bounds that follow from the anchor alone, so every score has
an interval that narrows with each plane, and a row is dropped as soon as its interval cannot qualify: for positives, if it
lies under the k-th largest lower end; for negatives, if it misses every window of scores that the anchor's positives allow, or
lies under k rows that are surely inside. Scores of the rows that are left are exact.

Anchors (a stated set of queries) meet all rows in blocks: rows and anchors are dealt to a grid, each cell holds at most
ROWS rows and ANCHORS anchors, and puts out the best few of each anchor; a ranked window then takes the best of all cells. Rows are
dealt by their number, so neither a hot label nor repeated vectors make a cell larger.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. A null id is never an
anchor, and comes last among ties. Rows that repeat, also with one id, are rows of their own: each counts, and each is an anchor if
its id is. Among equal scores and ids the order does not show. Vectors of different length are held against each other as if
the shorter ended with zeros. Without another row of its label, or without a row in the window, an anchor has no result; an
empty table has none. Scores that may pass 2**62 stop the run. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloft.sources.tables import durable, table

ROWS, ANCHORS, CHUNK = 16_384, 8_192, 256


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def whole_numbers(vectors: pd.Series, scale: int, width: int = 0) -> np.ndarray:
    """floor(scale * component), a row for each vector; at least width columns, zeros behind the end of shorter vectors."""
    sizes = vectors.map(len)
    out = np.zeros((len(vectors), max(sizes.max() if len(sizes) else 0, width)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    out = np.floor(out * scale)
    if np.abs(out).max(initial=0) >= 2**62:
        raise OverflowError("components are too large for whole numbers of 64 bits")
    return out.astype(np.int64)


class BitSlices:
    """Rows of whole numbers as bit-planes, the most significant first. A number is its planes' sum less 2**bits."""

    def __init__(self, x: np.ndarray, heaviest: int):
        """heaviest: the largest sum of an anchor's absolute components; products of a plane are at most that."""
        self.bits = int(np.abs(x).max(initial=0)).bit_length()
        if heaviest << self.bits + 1 >= 2**62:
            raise OverflowError("scores may pass 64 bits")
        kind = np.float32 if heaviest < 2**24 else np.float64 if heaviest < 2**53 else np.int64  # each exact up to there
        shifted = x + (1 << self.bits)
        self.planes = [(p, (shifted >> p & 1).astype(kind)) for p in range(self.bits, -1, -1)]

    def scores(self, q: np.ndarray, rows: slice | np.ndarray, keep: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor q: its number, rows that were not dropped, their scores. keep(anchor, rows, known, low, high): which rows to
        go on with, whose scores lie between low and high."""
        below, weight = np.minimum(q, 0).sum(1), np.abs(q).sum(1)
        known = np.repeat(-(q.sum(1) << self.bits)[:, None], len(self.planes[0][1][rows]), 1)
        done = 0
        for p, plane in self.planes:  # while intervals are wider than scores differ nothing can be dropped: all rows at once
            known += (q.astype(plane.dtype) @ plane[rows].T).astype(np.int64) << p
            done += 1
            if ((1 << p) - 1) * np.median(weight) <= 2 * known.std():
                break
        numbers = np.arange(len(self.planes[0][1]))[rows]
        for a in range(len(q)):
            at, score = numbers, known[a]
            own = q[a].astype(self.planes[0][1].dtype)
            for p, plane in [*self.planes[done:], (-1, None)]:
                rest = (1 << p + 1) - 1  # what the planes from p on can add, for each unit of the anchor
                low = score + rest * below[a]
                mask = keep(a, at, score, low, low + rest * weight[a])
                at, score = at[mask], score[mask]
                if plane is None or not len(at):
                    break
                score = score + ((plane[at] @ own).astype(np.int64) << p)
            yield a, at, score


def _largest(values: np.ndarray, k: int) -> int:
    """The k-th largest of at least k values."""
    return np.partition(values, len(values) - k)[len(values) - k]


def _best(at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller numbers."""
    if len(at) > k:
        few = np.flatnonzero(score >= _largest(score, k))
    else:
        few = np.arange(len(at))
    return few[np.lexsort((at[few], -score[few]))][:k]


def _cell(rows: pd.DataFrame, anchors: pd.DataFrame, scale: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by id, and both as whole numbers of one width."""
    rows = rows.sort_values(["bare", "vec_id"], kind="stable", ignore_index=True)
    x = whole_numbers(rows["vector"], scale)
    q = whole_numbers(anchors["vector"], scale, x.shape[1])
    return rows, anchors, np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1]))), q


def _heaviest(q: np.ndarray) -> int:
    return int(np.abs(q).sum(1).max(initial=0))


def _grid(rows: DataFrame, anchors: DataFrame, f: Callable, schema: str, tasks: int) -> DataFrame:
    """f for every cell of the grid, and the blocks' sizes bounded; at least `tasks` blocks of rows if there are many rows."""
    n, m = rows.count(), anchors.count()
    high, wide = max(-(-n // ROWS), min(tasks, -(-n // 1024)), 1), max(-(-m // ANCHORS), 1)
    block = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = rows.withColumn("_i", block(high)).withColumn("_j", every(wide))
    b = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # names of its own: rows and anchors come from one table
    b = b.withColumn("_j", block(wide)).withColumn("_i", every(high))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(f, schema)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """vectors: vec_id, label, vector. For each anchor and each of its `positives` best rows of the same label, the `negatives`
    best rows of other labels whose score is from low to high percent of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    zero = F.lit(0).cast(kind)  # pandas has no whole numbers with nulls
    named = [F.coalesce("vec_id", zero).alias("vec_id"), F.col("vec_id").isNull().alias("bare"), F.coalesce(anchors, F.lit(False)).alias("asked")]
    rows = durable(vectors.where(F.col("label").isNotNull() & finite(F.col("vector"))).select(*named, "label", "vector", F.monotonically_increasing_id().alias("row")))
    asked, rows = rows.where("asked and not bare").drop("asked", "bare"), rows.drop("asked")
    tasks = 2 * spark.sparkContext.defaultParallelism

    def alike(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            rows, anchors, x, q = _cell(rows, anchors, scale)
            slices, labels, ids = BitSlices(x, _heaviest(q)), rows["label"].to_numpy(), rows["row"].to_numpy()
            for label, own in anchors.groupby("label"):
                same = np.flatnonzero(labels == label)
                for begin in range(0, len(own), CHUNK) if len(same) else ():
                    part = own.iloc[begin : begin + CHUNK]
                    names = part["row"].to_numpy()

                    def keep(a, at, known, low, high, names=names):
                        other = ids[at] != names[a]
                        return other & (high >= _largest(low[other], positives)) if other.sum() > positives else other

                    for a, at, score in slices.scores(q[anchors.index.get_indexer(part.index)], same, keep):
                        for k in _best(at, score, positives):
                            out.append((names[a], rows["vec_id"].iat[at[k]], rows["bare"].iat[at[k]], score[k]))
        return pd.DataFrame(out, columns=["row", "positive_id", "bare", "positive_score"])

    found = _grid(rows, asked, alike, f"row long, positive_id {kind}, bare boolean, positive_score long", tasks)
    found = found.withColumn("positive_id", F.when(~F.col("bare"), F.col("positive_id")))
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))
    found = found.withColumn("nth", nth).where(F.col("nth") <= positives)
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))  # a few for each
    listed = listed.select("row", F.col("positives.nth").alias("nth"), F.col("positives.positive_score").alias("aims"), F.col("positives.positive_id").alias("aim_ids"))
    asked = durable(asked.join(listed, "row"))

    def unlike(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            rows, anchors, x, q = _cell(rows, anchors, scale)
            slices, labels = BitSlices(x, _heaviest(q)), rows["label"].to_numpy()
            for begin in range(0, len(anchors), CHUNK):
                part = anchors.iloc[begin : begin + CHUNK]
                own, names = part["label"].to_numpy(), part["row"].to_numpy()
                windows = [[(-(-low * int(s) // 100), high * int(s) // 100) for s in aims] for aims in part["aims"]]

                def keep(a, at, known, least, most, own=own, windows=windows):
                    fits = np.zeros(len(at), bool)
                    for lo, hi in set(windows[a]):
                        fit, sure = (most >= lo) & (least <= hi), (least >= lo) & (most <= hi) & (labels[at] != own[a])
                        if np.count_nonzero(sure) > negatives:
                            fit &= most >= _largest(least[sure], negatives)
                        fits |= fit
                    return fits & (labels[at] != own[a])

                for a, at, score in slices.scores(q[begin : begin + CHUNK], slice(None), keep):
                    for nth, (lo, hi) in zip(part["nth"].iat[a], windows[a]):
                        inside = np.flatnonzero((score >= lo) & (score <= hi))
                        for k in inside[_best(at[inside], score[inside], negatives)]:
                            out.append((names[a], nth, rows["vec_id"].iat[at[k]], rows["bare"].iat[at[k]], score[k]))
        return pd.DataFrame(out, columns=["row", "nth", "negative_id", "bare", "negative_score"])

    found = _grid(rows, asked, unlike, f"row long, nth int, negative_id {kind}, bare boolean, negative_score long", tasks)
    found = found.withColumn("negative_id", F.when(~F.col("bare"), F.col("negative_id")))
    rank = F.row_number().over(Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    aims = asked.select("row", F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("nth", "aim_ids", "aims")).alias("aim"))
    aims = aims.select("row", "anchor_id", F.col("aim.nth").alias("nth"), F.col("aim.aim_ids").alias("positive_id"), F.col("aim.aims").alias("positive_score"))
    return found.join(aims, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose id is divisible by 100; labels of ids divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), F.col("embedding").alias("vector"))
    return mine(vectors, F.col("vec_id") % 100 == 0)
