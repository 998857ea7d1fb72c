"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. Only pairs of blob and rule version that the ledger does not hold
are scanned, each blob once, whatever number of paths holds it; findings are then joined to all paths. The ledger and
the findings are Parquet folders that grow by one part per scan.

Only DataFrame functions. Of a blob the smallest path that holds it is found from hashes alone, so copies of one text are
summed in the map stage and no task gets the texts of a group of copies. Texts are joined with the unseen blobs before any
pattern looks at them: if those are few they are broadcast, else the texts are shuffled once. Matches are rows, whose places
are running sums over the gaps between them, so work is linear in a text and its matches; patterns begin where a run of their
characters begins, so none reads a run twice.

Defined results: null text counts as empty, with no findings. Repeated rows each get the findings. Null path ids are
paths like others; one path id may have any number of texts. Spans of one start come in the order of RULES. Very long texts
are scanned whole. Empty tables give empty results. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloft.sources.tables import durable, fresh_dir, table

#: Kind, pattern, group whose length counts, its least length. Base kinds first, in their order.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "3"
SPANS = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"
CUTS = "array<struct<start:bigint,end:bigint>>"
#: Lists of unseen blobs of at most so many rows are broadcast. Code points of a block of a text that is being redacted.
BROADCAST_NEW, BLOCK = 10_000, 1024


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, pattern: str, group: int, no: int) -> Column:
    """no, i (from 0), gap (code points between the match before, or the start, and this one), size and counts (the length that
    decides) of each leftmost match that does not overlap. What lies between comes from a split by the same pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), kept.alias("kept"))
    return F.transform(zipped, lambda m, i: F.struct(
        F.lit(no).alias("no"), i.alias("i"), F.length(m["gap"]).cast("long").alias("gap"), F.length(m["found"]).cast("long").alias("size"),
        F.length(m["kept"]).alias("counts")))


def findings(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs: blob, body. blob, spans (all findings by start, then kind; in code points, end exclusive) and cuts (their union:
    in order, apart) of every blob that has findings."""
    text = F.col("body")
    none = F.array().cast("array<struct<no:int,i:int,gap:bigint,size:bigint,counts:int>>")
    listed = F.flatten(F.array(*[F.when(text.rlike(p), _matches(text, p, group, no)).otherwise(none) for no, (_, p, group, _) in enumerate(rules)]))
    # explode_outer: before explode Spark would filter by the list's size, below the join that finds unseen blobs
    hits = blobs.select("blob", F.explode_outer(listed).alias("m")).where("m is not null").select("blob", "m.*")
    hits = hits.repartition("blob").dropDuplicates(["blob", "no", "i"])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    kinds, least = F.array(*[F.lit(r[0]) for r in rules]), F.array(*[F.lit(r[3]) for r in rules])
    spans = hits.select("blob", "no", "counts", (end - F.col("size")).alias("start"), end.alias("end"))
    spans = spans.where(F.col("counts") >= F.get(least, F.col("no"))).drop("counts")
    order = Window.partitionBy("blob").orderBy("start", "no")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("begins", covered.isNull() | (F.col("start") >= covered))
    spans = spans.withColumn("cut", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("cut_end", F.max("end").over(Window.partitionBy("blob", "cut")))
    span = F.struct("start", F.col("no").alias("kind_no"), F.get(kinds, F.col("no")).alias("kind"), "end")
    cut = F.when(F.col("begins"), F.struct("start", F.col("cut_end").alias("end")))
    return spans.groupBy("blob").agg(
        F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"), F.array_sort(F.collect_list(cut)).cast(CUTS).alias("cuts"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_incremental(
    versions: DataFrame, ledger_dir: str, path: str = "doc_id", text: str = "text", rules=RULES, rule_version: str = RULE_VERSION
) -> DataFrame:
    """Scans what the ledger in `ledger_dir` lacks, adds it there, and returns every version's path, blob, spans and cuts.

    The ledger holds `blobs` (blob, rule_version) and `findings` (blob, rule_version, spans, cuts; blobs with findings only).
    Findings are written before the ledger's entry, and readers take one finding per blob, so a scan that broke off
    between the two is repeated without harm.
    """
    spark = versions.sparkSession
    texts = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    paths = texts.select("path", "blob")
    seen = _read(spark, f"{ledger_dir}/blobs", "blob string, rule_version string").where(F.col("rule_version") == rule_version)
    first = paths.groupBy("blob").agg(F.min("path").alias("first")).join(seen, "blob", "left_anti")
    first = durable(first.select(F.col("blob").alias("new_blob"), "first"))
    unseen = F.broadcast(first) if first.count() <= BROADCAST_NEW else first
    new = texts.join(unseen, F.col("path").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("new_blob")), "left_semi")
    found = findings(new.select("blob", "body"), rules)
    found.select("blob", F.lit(rule_version).alias("rule_version"), "spans", "cuts").write.mode("append").parquet(f"{ledger_dir}/findings")
    first.select(F.col("new_blob").alias("blob"), F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{ledger_dir}/blobs")
    known = _read(spark, f"{ledger_dir}/findings", f"blob string, rule_version string, spans {SPANS}, cuts {CUTS}")
    known = durable(known.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"]).select("blob", "spans", "cuts"))
    none = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("spans", SPANS), ("cuts", CUTS))]
    return paths.join(known, "blob", "left").select("path", "blob", *none)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points. To be a column of its own, which `redact` refers to."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def redact(blocks: Column, cuts: Column, mark: str = "[secret]") -> Column:
    """The text of the blocks with every cut replaced by `mark`. What lies between cuts is taken from the blocks that it
    touches, so no text is walked through from its begin for each cut."""
    n = (F.size(blocks) - 1) * BLOCK + F.length(F.element_at(blocks, -1))

    def between(c: Column, i: Column) -> Column:
        p, q = F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)).cast("int"), c["start"].cast("int")
        a, z = F.floor(p / BLOCK).cast("int"), F.floor(q / BLOCK).cast("int")
        head, tail = F.get(blocks, a), F.coalesce(F.get(blocks, z), F.lit(""))
        several = F.concat(
            F.substring(head, p % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, a + 2, F.greatest(z - a - 1, F.lit(0))), ""),
            F.substring(tail, F.lit(1), q % BLOCK))
        return F.when(p == q, F.lit("")).when(a == z, F.substring(head, p % BLOCK + 1, q - p)).otherwise(several)

    ends = F.concat(cuts, F.array(F.struct(n.cast("long").alias("start"), n.cast("long").alias("end"))))
    return F.array_join(F.transform(ends, between), mark)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_incremental(table(spark, sf_dir, "documents"), fresh_dir(spark, "secret-ledger"))
    spans = F.col("spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"), *[number(kind) for kind in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"), "blob")
