"""Top-k by inner product through an inverted-list index.

Centroids are fitted on a bounded sample (the SAMPLE vectors with the smallest hash of their id); every vector is then put into the list
of its nearest centroid and stored, in order of lists, with the lists' radii beside them. A search scores a query against the centroids
and reads the lists that promise most. As q.x <= q.c + |q| |x - c|, a list whose centroid's product plus |q| times its radius is
below the k-th best found can't hold a better one; in exact mode all other lists are read too, so the result is that of a full
search, without a loop over pairs of rows. How much that saves depends on how far the vectors cluster.

Lists and the queries that ask for them are cut into blocks of bounded size, so a list with a third of all vectors, or one that all queries
want, is many groups of rows. What reaches the driver are the sample, the centroids and a row for each list.

Defined results: vectors that are null or hold null or non-finite components, and those without an id, are not indexed; such queries have
no result. Shorter vectors end with zeros; what a query has beyond the index's dimension counts as zero. Equal scores (rounded) go
by id. Query ids must be unique; vector ids may repeat, each row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sparkloft.plans.registry import query
from sparkloft.sources.tables import durable, fresh_dir, table

SAMPLE, MOST_LISTS, STEPS, DIGITS = 8_192, 1_024, 8, 6
CHUNK, QUERIES = 8_192, 4_096
#: Rows times lists that a task looks at, or puts out, at once.
CELLS = 131_072


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def stacked(vectors: pd.Series, size: int) -> np.ndarray:
    """A matrix with a row for each vector, cut or filled with zeros to one size."""
    if vectors.map(len).eq(size).all():
        return np.vstack(vectors).astype(float) if len(vectors) else np.zeros((0, size))
    out = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v[:size]
    return out


def pieces(batches: Iterator[pd.DataFrame], lists: int) -> Iterator[pd.DataFrame]:
    """The rows of batches, so few at a time that rows times lists are bounded; none is empty."""
    step = max(CELLS // lists, 1)
    for b in batches:
        for begin in range(0, len(b), step):
            yield b.iloc[begin : begin + step]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    at = np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)
    return at, np.linalg.norm(x - centroids[at], axis=1)


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of a sample by Lloyd's steps; a centroid that no vector is near to stays where it was."""
    r = np.random.default_rng(11)
    centroids = sample[r.permutation(len(sample))[:lists]].copy()
    for _ in range(STEPS):
        at, _ = nearest(sample, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


class VectorIndex:
    """An index in a folder: `vectors` (list, vec_id, vector) and `lists` (list, centroid, radius, n)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        lists = sorted(spark.read.parquet(f"{path}/lists").collect(), key=lambda r: r["list"])  # MOST_LISTS rows at most
        self.centroids = np.array([r["centroid"] for r in lists], float)
        self.radius, self.n = np.array([r["radius"] for r in lists], float), [r["n"] for r in lists]

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, vec_id: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex | None:
        """lists: by default the square root of the number of vectors. None if there is nothing to index."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        known = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
        if not known["n"]:
            return None
        size, wanted = known["size"], min(max(lists or round(known["n"] ** 0.5), 1), MOST_LISTS)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
        centroids = fitted(stacked(sample, size), wanted)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in pieces(batches, len(centroids)):
                at, gap = nearest(stacked(b["vector"], size), centroids)
                yield b.assign(list=at.astype("int32"), gap=gap)

        schema = StructType([*rows.schema, StructField("list", IntegerType()), StructField("gap", DoubleType())])
        put = rows.mapInPandas(placed, schema).repartitionByRange("list", F.xxhash64("vec_id")).sortWithinPartitions("list")
        put.write.mode("overwrite").parquet(f"{path}/vectors")
        held = {r["list"]: r for r in spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
        rows = [(k, c.tolist(), held[k]["radius"] if k in held else 0.0, held[k]["n"] if k in held else 0) for k, c in enumerate(centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls(spark, path)

    def search(self, asked: DataFrame, k: int, query: str = "query", vector: str = "q", probes: int = 8, exact: bool = True, skip_same: bool = False) -> DataFrame:
        """query, found, score and rank (from 1) of the k best of each query. exact: as if all vectors had been read; else of the `probes` most
        promising lists alone. skip_same: a vector with the query's own id is not found."""
        rows = asked.select(F.col(query).alias("query"), F.col(vector).alias("q"))
        rows = durable(rows.where(F.col("query").isNotNull() & usable(F.col("q"))))
        first = self._ranked(self._met(self._lists(rows.withColumn("floor", F.lit(None).cast("double")), probes), k, skip_same), k)
        if not exact:
            return first
        first = durable(first)
        floors = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        rest = self._lists(rows.join(floors, "query", "left"), probes, rest=True)
        return self._ranked(first.drop("rank").unionByName(self._met(rest, k, skip_same)), k)

    def _lists(self, rows: DataFrame, probes: int, rest: bool = False) -> DataFrame:
        """rows: query, q, floor. A row for each list to read: the first `probes`, or the rest that may hold what is above the floor."""
        centroids, radius, filled = self.centroids, self.radius, np.array(self.n) > 0

        def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in pieces(batches, len(centroids)):
                q = stacked(b["q"], centroids.shape[1])
                near, norm = q @ centroids.T, np.linalg.norm(q, axis=1)[:, None]
                most = np.where(filled, near + norm * radius, -np.inf)
                order = np.argsort(-np.where(filled, near, -np.inf), axis=1, kind="stable")
                take = np.zeros(near.shape, bool)
                np.put_along_axis(take, order[:, :probes], True, axis=1)
                take &= filled
                if rest:
                    least = b["floor"].fillna(-np.inf).to_numpy(float)[:, None]
                    slack = 10.0**-DIGITS + 1e-9 * (1 + norm * (np.abs(radius) + np.linalg.norm(centroids, axis=1)))
                    take = ~take & filled & (most >= least - slack)
                at, lists = np.nonzero(take)
                yield pd.DataFrame({"query": b["query"].to_numpy()[at], "q": b["q"].to_numpy()[at], "list": lists.astype("int32")})

        schema = StructType([*rows.select("query", "q").schema, StructField("list", IntegerType())])
        return durable(rows.mapInPandas(wanted, schema))

    def _met(self, pairs: DataFrame, k: int, skip_same: bool) -> DataFrame:
        """pairs: query, q, list. The k best of each block of a list for each query in it."""
        size = self.centroids.shape[1]
        asked = {r["list"]: r["n"] for r in pairs.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        blocks = [(at, -(-self.n[at] // CHUNK), -(-n // QUERIES)) for at, n in asked.items()]
        plan = lambda: F.broadcast(self.spark.createDataFrame(blocks, "list int, chunks int, blocks int"))  # noqa: E731  MOST_LISTS rows at most
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        stored = self.vectors.select("list", "vec_id", "vector")
        if len(asked) < len(self.n):
            stored = stored.where(F.col("list").isin(list(asked)))  # reaches the files, which are in order of lists
        a = stored.join(plan(), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vector"), F.col("chunks")).cast("int")).withColumn("block", every("blocks"))
        b = pairs.join(plan(), "list").withColumn("block", part("query", "blocks")).withColumn("chunk", every("chunks"))
        keys = ["list", "chunk", "block"]

        def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(asked):
                rows = rows.sort_values("vec_id", kind="stable", ignore_index=True)
                x, q, ids, names = stacked(rows["vector"], size), stacked(asked["q"], size), rows["vec_id"].to_numpy(), asked["query"].to_numpy()
                for begin in range(0, len(q), 256):
                    scores = q[begin : begin + 256] @ x.T
                    for name, score in zip(names[begin : begin + 256], scores):
                        at = np.flatnonzero(ids != name) if skip_same else np.arange(len(ids))
                        shown = np.round(score[at], DIGITS)
                        if len(at) > k:
                            few = np.flatnonzero(shown >= np.partition(shown, len(at) - k)[len(at) - k])
                            at, shown = at[few], shown[few]
                        for n in at[np.argsort(-shown, kind="stable")[:k]]:
                            out.append((name, ids[n], float(score[n])))
            return pd.DataFrame(out, columns=["query", "found", "score"])

        kinds = pairs.schema["query"].dataType.simpleString(), stored.schema["vec_id"].dataType.simpleString()
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(best, f"query {kinds[0]}, found {kinds[1]}, score double")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        found = found.withColumn("score", F.round("score", DIGITS))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found")).cast("long")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _top3(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    """A search: queries are the vectors whose id is divisible by 100, against all vectors; the three best are the result."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(vectors, fresh_dir(spark, "vector-index"))
    if index is None:
        return spark.createDataFrame([], "query long, found long, k long")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    probes = 8 if exact else -(-len(index.n) * 3 // 4)
    return index.search(asked, 3, probes=probes, exact=exact, skip_same=True).select("query", "found", F.col("rank").alias("k"))


@query("""
    WITH pairs AS (SELECT q.vec_id AS query, b.vec_id AS found, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
      FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query, found, k FROM (SELECT query, found, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, found) AS k FROM pairs) WHERE k <= 3""")
def vector_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact: lists that the index's bounds can't rule out are read too."""
    return _top3(spark, sf_dir, exact=True)
