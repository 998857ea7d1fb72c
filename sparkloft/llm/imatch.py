"""I-Match fingerprints with randomised lexicons.

A text's terms are its distinct lower-case words. The lexicon holds the terms whose inverse document frequency ln(documents /
documents with the term) lies in BAND, and that stand in at least MIN_DOCS documents: rarer words are noise, words of a large
part of all documents say nothing. Each of the randomised subsets keeps a lexicon term with a probability of its own (RATES);
a text's terms in a subset, distinct and sorted, are hashed to one signature. The fingerprint is the number of terms and the
list of signatures.

Document frequencies are exact: every task counts its distinct terms (64-bit hashes), Spark adds them up. As documents hold A
distinct terms on average, at most A times exp(BAND's end) terms can be in the band, whatever the number of documents; so the
lexicon is sent to the tasks as a sorted list of hashes. Its size is counted first; beyond MAX_LEXICON terms (128 MB) it is cut into
parts by hash, and the terms of all texts, kept as hashes in the shared folder, are held against one part after the other. The
fingerprints are the same, and no task holds more than a part.

Likeness: two texts that differ in d terms (of one or the other) have equal signatures at rate p with probability (1 - p)^d,
those that are empty for both included. The likeness is the share of terms in common, 1 - d / (terms of both), under which the
observed equal and unequal signatures are most probable; a mean over all shares would be drawn to the middle.

Defined results: null text counts as empty. A text with terms but none in the band uses all its terms; the empty text has no
terms and the signature 0 throughout. Likeness is 1 for equal fingerprints and for no others. The order of documents is by id, those
without one last; documents of one id (or none) follow each other by a hash of their texts, equal ones in any order. One
document alone follows itself. Very long texts are read whole; one text at a time is held. Empty tables give empty results. Only the
named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.llm.batches import filled
from sparkloft.sources.tables import durable, table

#: Inverse document frequencies (natural logarithm) of the lexicon: from a twentieth of all documents to one in 49,000.
BAND, MIN_DOCS, MAX_LEXICON = (3.0, 10.8), 2, 16_000_000
#: Documents of a range, and most ranges. A range is streamed, so its size bounds no memory.
RANGE_DOCS, MAX_RANGES = 4000, 40_000
#: Chance of a lexicon term to be in each subset; the first is the whole lexicon.
RATES = (1.0, *(2.0**-k for k in range(1, 12) for _ in range(5)))
_LIMITS = np.array([min(int(r * 2**64), 2**64 - 1) for r in RATES], np.uint64)
_SEEDS = np.array([xxhash.xxh64_intdigest(f"lexicon {k}") | 1 for k in range(len(RATES))], np.uint64)
#: Shares of terms in common that are tried.
_SHARES = np.arange(0, 1, 1 / 40)
_LEVELS, _LEVEL = np.unique(RATES, return_inverse=True)
_DIFFER = np.log1p(-np.minimum(_LEVELS, 1 - 1e-9))


def terms(text: str) -> np.ndarray:
    """Hashes of the distinct words, ascending."""
    digest = xxhash.xxh64_intdigest
    return np.sort(np.fromiter((digest(w) for w in set(text.lower().split())), np.uint64))


def inside(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Those of the hashes that the lexicon holds, in order."""
    if not len(lexicon):
        return hashes[:0]
    at = np.searchsorted(lexicon, hashes)
    return hashes[lexicon[np.minimum(at, len(lexicon) - 1)] == hashes]


def signatures(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Of a text's terms: those in the lexicon count, or all if none is."""
    found = inside(hashes, lexicon)
    return signed(found if len(found) else hashes)


def signed(chosen: np.ndarray) -> np.ndarray:
    """The number of terms that count, and one 32-bit signature per subset; 0 where the subset holds no term of the text."""
    out = np.zeros(len(RATES) + 1, np.uint32)
    if not len(chosen):
        return out
    out[0] = len(chosen)
    mixed = chosen[None, :] * _SEEDS[:, None]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    keep = mixed <= _LIMITS[:, None]
    for k in np.flatnonzero(keep.any(axis=1)):
        out[k + 1] = xxhash.xxh32_intdigest(chosen[keep[k]].tobytes()) or 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of terms in common; see above."""
    same = a == b
    if same.all():
        return 1.0
    both = int(a[0]) + int(b[0])
    differ = np.maximum(1 - _SHARES, 1 / both) * both
    differ = np.maximum(differ, abs(int(a[0]) - int(b[0])))
    equal = np.minimum(np.outer(differ, _DIFFER), -1e-12)
    found, all_ = np.bincount(_LEVEL[same[1:]], minlength=len(_LEVELS)), np.bincount(_LEVEL)
    chance = equal @ found + np.log(-np.expm1(equal)) @ (all_ - found)
    return float(1 - differ[chance.argmax()] / both)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def lexicon_parts(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND, min_docs: int = MIN_DOCS, most: int = MAX_LEXICON) -> list[DataFrame]:
    """The hashes of the terms in the band, in as few parts as hold some `most` each."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in filled(batches):
            for t in b["body"]:
                held.append(terms(t))
                size += len(held[-1])
            if size > 4_000_000:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)

    n = rows.count()
    idf = F.log(F.lit(float(max(n, 1))) / F.col("n"))
    counted = rows.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = durable(counted.where((F.col("n") >= min_docs) & idf.between(*band)).select("term"))
    parts = max(1, -(-found.count() // most))
    return [found.where(F.pmod("term", F.lit(parts)) == k) for k in range(parts)]


def loaded(part: DataFrame) -> np.ndarray:
    """The hashes of a part, ascending."""
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in part.toArrow()["term"].chunks)]).view(np.uint64))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND, min_docs: int = MIN_DOCS) -> np.ndarray:
    """The hashes of all terms in the band, ascending, for lexicons that one task can hold."""
    return np.sort(np.concatenate([loaded(p) for p in lexicon_parts(docs, text, band, min_docs)]))


def held_against(rows: DataFrame, columns: list[str], parts: list[DataFrame]) -> DataFrame:
    """The rows with each of the columns (a text's terms: hashes as bytes, ascending) cut down to the terms that are in one of the parts;
    left whole if none is. One part at a time is sent to the tasks."""
    schema = rows.schema
    left = rows.select(*rows.columns, *[F.lit(b"").alias(f"_{c}") for c in columns])
    wide, sent = left.schema, rows.sparkSession.sparkContext.broadcast

    def narrowed(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in columns:
                    at = b.schema.get_field_index(f"_{c}")
                    more = [old + inside(np.frombuffer(h, np.uint64), shared.value).tobytes() for h, old in zip(b.column(c).to_pylist(), b.column(at).to_pylist())]
                    b = b.set_column(at, f"_{c}", pa.array(more, pa.binary()))
                yield b

        return left.mapInArrow(run, wide)

    for part in parts:
        shared = sent(loaded(part))
        left = durable(narrowed(shared))
        shared.unpersist()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in columns:
                best = [np.sort(np.frombuffer(few or h, np.uint64)).tobytes() for h, few in zip(b.column(c).to_pylist(), b.column(f"_{c}").to_pylist())]
                b = b.set_column(b.schema.get_field_index(c), c, pa.array(best, pa.binary()))
            yield b.select(schema.names)

    return left.mapInArrow(chosen, schema)


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    term, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"term": term.view(np.int64), "n": n})


def fingerprints(docs: DataFrame, known: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents with a column `name` of fingerprints, 8 hex digits for the number of terms and for each subset."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([written(signatures(terms(t or ""), shared.value)) for t in texts], dtype=object)

    return docs.withColumn(name, of(F.coalesce(F.col(text), F.lit(""))))


KEY = "struct<no_id:boolean,id:bigint,h:bigint>"


def range_of(key: Column, cuts: list, kind: str = "bigint") -> Column:
    """How many of the ascending cuts are at most the key: first among every so manieth, then among those between."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    firsts = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), f"array<{kind}>")
    inner = F.from_json(F.lit(json.dumps(blocks)), f"array<array<{kind}>>")
    k = F.size(F.filter(firsts, lambda c: c <= key))
    return F.when(k == 0, 0).otherwise((k - 1) * step + F.size(F.filter(F.try_element_at(inner, F.greatest(k, F.lit(1))), lambda c: c <= key)))


def follow(docs: DataFrame, lexicon: list[DataFrame], per_part: int = RANGE_DOCS) -> DataFrame:
    """docs: doc_id (long), body (not null). Each document's fingerprint, that of its text with the last quarter replaced by the
    start of the next document (by id), and the likeness to it and to the next document.

    The texts are shuffled once, by ranges of ids, each range to a task of its own; the head of each range is also sent to the
    range before.
    """
    spark = docs.sparkSession
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("body").alias("h")).cast(KEY)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "body", key.alias("key"))
    keys = docs.select("key")
    n = keys.count()
    if not n:
        return spark.createDataFrame([], FOLLOWED_DDL)
    parts = max(1, min(MAX_RANGES, n // per_part))
    drawn = []
    if parts > 1:  # bounds of ranges only
        drawn = sorted(tuple(r) for r in keys.sample(fraction=min(1.0, 50 * parts / n), seed=1).select("key.*").collect())
    cuts = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    dealt = docs.withColumn("part", range_of(F.col("key"), [dict(zip(("no_id", "id", "h"), c)) for c in cuts], KEY))
    heads = dealt.groupBy("part").agg(F.min("key").alias("head"))
    found = sorted((r["part"], tuple(r["head"])) for r in heads.collect())  # one row per range
    before = spark.createDataFrame([(*head, found[k - 1][0]) for k, (_, head) in enumerate(found)], "no_id boolean, id bigint, h bigint, part int")
    firsts = docs.join(F.broadcast(before), (F.col("key.no_id") == F.col("no_id")) & (F.col("key.id") == F.col("id")) & (F.col("key.h") == F.col("h")))
    firsts = firsts.groupBy("part").agg(F.min("body").alias("body"))  # at most MAX_RANGES rows
    tails = firsts.select(F.lit(None).cast("long").alias("doc_id"), "body", F.lit(None).cast(KEY).alias("key"), "part", F.lit(1).alias("tail"))
    both = dealt.select("doc_id", "body", "key", "part", F.lit(0).alias("tail")).unionByName(tails)
    laid = both.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "key")
    one = len(lexicon) == 1
    shared = spark.sparkContext.broadcast(loaded(lexicon[0]) if one else None)
    shape = FOLLOWED if one else EDITED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for doc_id, body, range_, tail in zip(*(c.to_pylist() for c in b.columns)):
                mine = signatures(terms(body), shared.value) if one else terms(body)
                if last is not None and last[2] == range_:
                    out.append(_judge(last, body, mine, shared.value) if one else _edited(last, body, mine))
                last = None if tail else (doc_id, body, range_, mine)
            columns = list(zip(*out)) or [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    if one:
        return laid.select("doc_id", "body", "part", "tail").mapInArrow(run, FOLLOWED_DDL)
    terms_of = held_against(laid.select("doc_id", "body", "part", "tail").mapInArrow(run, EDITED_DDL), ["own", "edited", "after"], lexicon)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = [[signed(np.frombuffer(h, np.uint64)) for h in b.column(c).to_pylist()] for c in ("own", "edited", "after")]
            found = [(written(x), written(y), likeness(x, y), likeness(x, z)) for x, y, z in zip(*signs)]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, f.type) for c, f in zip(columns, list(FOLLOWED)[3:]))], schema=FOLLOWED)

    return terms_of.mapInArrow(judged, FOLLOWED_DDL)


FOLLOWED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
FOLLOWED_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("own", pa.binary()), ("edited", pa.binary()), ("after", pa.binary())])
EDITED_DDL = "doc_id long, n_chars long, edited_sha256 string, own binary, edited binary, after binary"


def _edited(doc: tuple, after: str, of_next: np.ndarray) -> tuple:
    doc_id, body, _, mine = doc
    edited, sha = edited_text(body, after)
    return doc_id, len(body), sha, mine.tobytes(), terms(edited).tobytes(), of_next.tobytes()


def edited_text(body: str, after: str) -> tuple[str, str]:
    """The text with its last quarter replaced by the start of the next, and its SHA-256."""
    n = len(body)
    edited = body[: n - n // 4] + after[: n // 4]
    return edited, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()


def _judge(doc: tuple, after: str, of_next: np.ndarray, known: np.ndarray) -> tuple:
    doc_id, body, _, mine = doc
    edited, sha = edited_text(body, after)
    other = signatures(terms(edited), known)
    return doc_id, len(body), sha, written(mine), written(other), likeness(mine, other), likeness(mine, of_next)


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return follow(docs, lexicon_parts(docs, "body"))
