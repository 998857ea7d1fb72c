"""Exact duplicates: odd rows, hot groups, and hashes made to collide."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sparkloft.llm import exact_dedup


def brute(rows):
    """rows: (id, text) to (id, keep_id, group_size, kept, sha256); of rows equal in length and id the first is kept."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for body, members in groups.items():
        first = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[first[3]][0], len(members), m == first, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [(5, "a b"), (4, "ab"), (3, "a\tb"), (2, None), (1, ""), (9, " \n\r\x0b\x0c "), (None, "ab"), (None, None), (7, "é 😀"), (6, "é😀"), (8, "a b"), (10, "A b")]
ODD += [(11, "same"), (11, "same"), (11, "same"), (12, "long " * 200_000), (13, "long" * 200_000), (11, "other")]


def length(column="text"):
    return F.length(F.coalesce(column, F.lit("")))


@pytest.mark.parametrize("most", [0, 500_000])
@pytest.mark.parametrize("digest", ["whole", "two values", "one value"])
def test_odd_rows_and_collisions(spark, digest, most):
    """Hashes of few values: all groups must be told apart by their bytes."""
    hashes = {"whole": exact_dedup.content_hash, "two values": lambda b: F.length(b) % 2, "one value": lambda b: F.lit(0)}
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"hash": F.lit(1), "row": F.lit(2), "body": F.lit("x")}).repartition(4)
    got = exact_dedup.exact_groups(docs, prefer=length(), digest=hashes[digest], most_broadcast=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ODD)


def test_smallest_id_stays_without_a_preference(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "xyz"), ("c", "x yz"), (None, "xyz"), ("d", "w")], "name string, body string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_groups(docs, "name", "body").collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("a", False), None: ("a", False), "d": ("d", True)}
    assert {r.name for r in exact_dedup.dropped_duplicates(docs, "name", "body").collect()} == {"a", "d"}
    assert exact_dedup.exact_groups(docs.limit(0), "name", "body").count() == 0


def test_hot_group(spark):
    """A third of the rows are one text."""
    rows = spark.range(30_000).select((30_000 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of a text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(rows, prefer=length())
    assert got.where("kept").count() == 20_001
    assert [tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(3, 10_000)]
