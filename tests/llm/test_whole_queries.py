"""Whole queries that SQL can't express, against plain versions without Spark."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloft.llm import quality
from tests.llm.test_duplicates import brute_links, linked_as, shingle_set
from tests.llm.test_filters import brute_leaks

SMALL = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def ridge(z, y):
    """By least squares over the rows and one more for each penalised weight."""
    penalty = np.sqrt([1e-9] + [quality.RIDGE * max(len(z), 1)] * (z.shape[1] - 1))
    return np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]


def test_quality_as_one_fit(spark):
    """The fit over all labelled rows at once; folds, steps and scores as the query's."""
    docs = {r.doc_id: np.array(quality.doc_stats(r.text or "")) for r in read(spark, "documents")}
    labels = [(r.doc_id, r.quality) for r in read(spark, "labels") if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y = np.vstack([docs[i] for i, _ in labels]), np.array([q for _, q in labels], float)
    folds = {r.id: r.fold for r in spark.createDataFrame([(i,) for i, _ in labels], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("fold")).collect()}
    fold = np.array([folds[i] for i, _ in labels])
    shift, scale = x.mean(0), x.std(0) + 1e-6
    w, b = quality.projection(x.shape[1])
    z = lambda s: np.hstack([np.ones((len(s), 1)), np.cos(np.clip((s - shift) / scale, -6, 6) @ w + b) * np.sqrt(2 / len(b))])
    rows = z(x)
    raw = np.zeros(len(y))
    for k in (0, 1):
        raw[fold == k] = rows[fold == k] @ ridge(rows[fold != k], y[fold != k])
    at = np.clip(np.round((raw + 0.5) * quality.BINS / 2), 0, quality.BINS)
    bins = np.unique(at)
    n, s = np.array([(at == k).sum() for k in bins], float), np.array([y[at == k].sum() for k in bins])
    steps = [[k, c, t] for k, c, t in zip(bins * 2 / quality.BINS - 0.5, n, s)]
    k = 0
    while k + 1 < len(steps):  # neighbours that fall are pooled, until none does
        (x0, n0, s0), (x1, n1, s1) = steps[k : k + 2]
        if s0 / n0 >= s1 / n1:
            steps[k : k + 2] = [[(x0 * n0 + x1 * n1) / (n0 + n1), n0 + n1, s0 + s1]]
            k = max(k - 1, 0)
        else:
            k += 1
    share = s.sum() / n.sum()
    levels = [(t + 2 * share) / (c + 2) for _, c, t in steps]
    weights = ridge(rows, y)
    want = {i: float(np.clip(np.interp(z(v[None]) @ weights, [k for k, _, _ in steps], levels), 0, 1)[0]) for i, v in docs.items()}
    got = {r.doc_id: r.score for r in quality.op9_quality_classifier(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    off = [abs(got[i] - want[i]) for i in want]
    assert np.median(off) < 1e-6 and np.mean(np.array(off) < 1e-3) > 0.99, sorted(off)[-3:]  # a row may fall into the next bin


def test_pipeline_as_plain_steps(spark):
    """What stays after each stage, from all pairs of texts, all pairs of documents and items, and one look for secrets at each text."""
    docs = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids, sets = sorted(texts), []
    for i in ids:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i])
        sets.append(shingle_set(lower) if lower.split() else set())
    root = linked_as(len(ids), [p for p in brute_links([s or {i} for i, s in enumerate(sets)], 0.8)])
    empty = [k for k, s in enumerate(sets) if not s]
    first = {}
    for k in range(len(ids)):
        first.setdefault("empty" if k in empty else root[k], ids[k])
    unique = {i: texts[i] for i in first.values()}
    leaked = {d for d, _ in brute_leaks(unique.items(), [(r.item_id, r.text) for r in read(spark, "benchmark")])}
    want = {i: t for i, t in unique.items() if i not in leaked}
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SMALL)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(unique)
    clean = corpus_pipeline.decontamination_stage(spark, kept, SMALL)
    assert {r.doc_id: r.text or "" for r in clean.collect()} == want
    after = {r.doc_id: r.text or "" for r in corpus_pipeline.secrets_stage(spark, clean, SMALL).collect()}
    secret = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    assert after.keys() == want.keys() and not any(secret.search(t) for t in after.values())
    assert all(after[i] == t for i, t in want.items() if not secret.search(t) and not re.search(r"(?i)passw|secret|token|api_?key|gh[pousr]_|github_pat|xox|eyJ|BEGIN", t))
    pieces = corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "start", "length").collect()
    assert {r.doc_id for r in pieces} == want.keys()
    for i in want:
        mine = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == i)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and all(s == sum(n for _, _, n in mine[:k]) for k, (_, s, _) in enumerate(mine))
