"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insults (with a weight), threats, targets, subjects, possessives, bodies (and what else a threat to
someone's may name), negation, reported speech, others. Words with an apostrophe count as what they are a form of. Five transducers rewrite this stream one after the other; each arc reads a symbol, writes one and multiplies the weight of what
the word may score:

- negation: a score within three words after a negation counts 0.4;
- reported speech: a score after a verb of saying counts 0.7;
- target: an insult after a person spoken of or to counts 1.25;
- threat: a threat with a target, or with someone's body, within the next three words becomes a match there;
- insult: an insult becomes a match, one right after another counts 1.2.

Clauses end at marks and quotation marks. A clause is read as reported from its start if it follows a verb of saying and a comma, or a
clause like "he said" follows it, and so are all clauses of a quotation that such words stand before or behind.

`compose` makes one transducer of two; the five become one table before any text is read. A clause's score is the sum of its
matches, each its own weight times the product of the arcs' factors. A document's score is a logistic function of its
clause scores: the highest, their sum, how many there are and their share.

The insult lexicon is a fixed seed list and what labels teach: words and word beginnings that toxic documents hold
more often than chance allows (binomial log-likelihood over a Bonferroni limit), the MAX_TERMS of them with the strongest evidence. It is learned from at most MAX_LABELS
labelled documents, the first in the order of a hash of the id. All of them count; near copies among them (five words, about
0.8 by MinHash sketches) share one vote, each copy a part of it, so that a group of copies teaches what one text does. The
whole corpus is then scored, each text where it is read.

Defined results: null text counts as empty; a text without a matched clause has the score of none. Null labels, labels
without an id and labels of unknown documents are ignored; without labels the seed list alone works. Repeated rows are scored
each; of texts with one id the first in order is learned from, once for each label. A null id is kept and teaches nothing.
Empty tables give empty results. Very long texts are read whole, clause by clause. Only the named columns are read, so others
may have any names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.llm.batches import filled
from sparkloft.llm.quality import held_out
from sparkloft.llm.simhash import shingle_hashes
from sparkloft.sources.tables import durable, table

MAX_LABELS, MAX_TERMS, PREFIXES = 20_000, 4096, range(4, 11)
#: MinHash sketch of a training text: places, places of a band, and the share of equal places that makes near copies.
PLACES, BAND, ALIKE = 64, 4, 0.75

#: Words of each class.
INSULTS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool dumb imbecile jerk filth vermin "
    "idioten dummkopf abschaum imbécile connard ordure idiota estúpido basura imbécil"
).split()
THREATS = "kill hurt destroy beat burn shoot stab crush murder strangle töten verletzen umbringen frapper tuer matar golpear".split()
TARGETS = "you yours him her them everyone dich euch vous toi ustedes".split()
POSSESSIVES = "your their dein deine deinen euer ton votre vos".split()
BODIES = (
    "face head neck throat skull teeth bones legs arms hands eyes body heart life house home family kids children child baby mother "
    "father mom dad brother sister wife husband son daughter friends friend dog"
).split()
SUBJECTS = "he she they people du ihr tu".split()
NEGATIONS = "not no never isn't aren't don't doesn't didn't won't nobody nicht kein keine pas jamais nunca".split()
REPORTS = "said says quoted wrote writes claimed called reported according sagte schrieb dit écrit dijo escribió".split()
#: Endings behind an apostrophe that leave the word before it what it is.
CLITICS = frozenset("re ve ll d s m".split())
OTHER, NEGATION, REPORT, TARGET, SUBJECT, POSSESSIVE, BODY, THREAT, INSULT, THREATENED, INSULTED = range(11)
CLASSES = (OTHER, NEGATION, REPORT, TARGET, SUBJECT, POSSESSIVE, BODY, THREAT, INSULT)
SCORED = (TARGET, BODY, THREAT, INSULT)
SEED_WEIGHT, THREAT_WEIGHT, REACH = 3.0, 1.5, 3

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_MARKS = r"""[.!?;:,\n"“”„«»]"""
_CLAUSE = re.compile(rf"({_MARKS}(?:\s*{_MARKS})*)")
_ENDS, _QUOTES = frozenset(".!?;\n"), frozenset('"“”„«»')


class Arc(NamedTuple):
    after: object
    out: int
    factor: float


class Transducer(NamedTuple):
    """Arcs by (state, symbol); a state that lacks a symbol passes it on unchanged at factor 1."""

    start: object
    arcs: dict[tuple[object, int], Arc]

    def step(self, state: object, symbol: int) -> Arc:
        return self.arcs.get((state, symbol)) or Arc(state, symbol, 1.0)

    def run(self, symbols: Iterable[int]) -> list[tuple[int, float]]:
        """What comes out for each symbol, and the factor."""
        state, out = self.start, []
        for s in symbols:
            state, written, factor = self.step(state, s)
            out.append((written, factor))
        return out


def _counting(begins: int, becomes: int, steps: dict[int, tuple[int, float]]) -> Transducer:
    """`begins` opens a scope of REACH words; `steps` names what other symbols turn into within it, and their factor. States
    are the words left."""
    arcs = {(n, begins): Arc(REACH, becomes, 1.0) for n in range(REACH + 1)}
    for n in range(1, REACH + 1):
        arcs |= {(n, s): Arc(n - 1, *steps.get(s, (s, 1.0))) for s in CLASSES if s != begins}
    return Transducer(0, arcs)


def negation() -> Transducer:
    return _counting(NEGATION, OTHER, {s: (s, 0.4) for s in SCORED})


def reported_speech() -> Transducer:
    arcs = {(k, REPORT): Arc(1, OTHER, 1.0) for k in (0, 1)}
    return Transducer(0, arcs | {(1, s): Arc(1, s, 0.7) for s in SCORED})


def target() -> Transducer:
    arcs = {(k, s): Arc(1, s, 1.0) for k in (0, 1) for s in (TARGET, POSSESSIVE)} | {(k, SUBJECT): Arc(1, OTHER, 1.0) for k in (0, 1)}
    return Transducer(0, arcs | {(1, INSULT): Arc(1, INSULT, 1.25)})


def threat() -> Transducer:
    """States: the words left of a threat's scope, and whether someone's, as in `your`, has been named in it."""
    closed, spent = (0, False), (TARGET, BODY, POSSESSIVE)
    arcs = {(closed, s): Arc(closed, OTHER, 1.0) for s in spent}
    for state in [closed, *((n, owned) for n in range(1, REACH + 1) for owned in (False, True))]:
        n, owned = state
        arcs[state, THREAT] = Arc((REACH, False), OTHER, 1.0)
        for s in CLASSES if n else ():
            after = (n - 1, owned or s == POSSESSIVE) if n > 1 else closed
            if s == TARGET or s == BODY and owned:
                arcs[state, s] = Arc(closed, THREATENED, 1.0)
            elif s != THREAT:
                arcs[state, s] = Arc(after, OTHER if s in spent else s, 1.0)
    return Transducer(closed, arcs)


def insult() -> Transducer:
    arcs = {(k, INSULT): Arc(1, INSULTED, 1.2 if k else 1.0) for k in (0, 1)}
    return Transducer(0, arcs | {(1, s): Arc(0, s, 1.0) for s in (OTHER, THREATENED)})


def compose(first: Transducer, second: Transducer, symbols: Iterable[int] = CLASSES) -> Transducer:
    """The transducer that does what `second` does to what `first` writes: pairs of states reachable from the start, arcs
    over the middle symbol, factors multiplied."""
    symbols, start = tuple(symbols), (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for s in symbols:
            a = first.step(state[0], s)
            b = second.step(state[1], a.out)
            after = (a.after, b.after)
            arcs[state, s] = Arc(after, b.out, a.factor * b.factor)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(start, arcs)


def grammar_table() -> tuple[list[tuple[int, float]], int]:
    """The five composed, states numbered from the start's 0: (next state times the number of classes, factor of the word's
    weight; a threat's weight is in the factor of its target) by state times classes plus class, and the number of states."""
    whole = negation()
    for t in (reported_speech(), target(), threat(), insult()):
        whole = compose(whole, t)
    code = {whole.start: 0}
    for state, _ in whole.arcs:
        code.setdefault(state, len(code))
    n = len(CLASSES)
    out = [(0, 0.0)] * (len(code) * n)
    for (state, s), arc in whole.arcs.items():
        factor = arc.factor if arc.out in (INSULTED, THREATENED) else 0.0
        out[code[state] * n + s] = (code[arc.after] * n, factor)
    return out, len(code)


class Grammar:
    """words, starts: weight by word and by beginning of a longer word."""

    def __init__(self, words: dict[str, float], starts: dict[str, float]):
        self.words, self.starts, self.table = words, starts, grammar_table()[0]
        fixed = ((NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0), (TARGETS, TARGET, THREAT_WEIGHT), (SUBJECTS, SUBJECT, 0.0), (POSSESSIVES, POSSESSIVE, 0.0),
                 (BODIES, BODY, THREAT_WEIGHT), (THREATS, THREAT, 0.0))
        self.fixed = {w: (c, weight) for ws, c, weight in fixed for w in ws}
        self.memo: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """Class of a word and what a match at it weighs."""
        found = self.memo.get(word)
        if found is None:
            weight = max([self.words.get(word, 0.0), *(self.starts.get(word[:n], 0.0) for n in PREFIXES if n < len(word))])
            found = (INSULT, weight) if weight else self.fixed.get(word)
            if not found and "'" in word:
                before, _, behind = word.rpartition("'")
                found = (NEGATION, 0.0) if word.endswith("n't") else self.read(before if behind in CLITICS else behind)
            found = found or (OTHER, 0.0)
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores above zero of the clauses, and the number of words."""
        hits: list[list] = []  # classes of a clause that may match, and whether it is reported
        n, read = 0, self.read
        parts = _CLAUSE.split(text.lower().replace("’", "'").replace("ʼ", "'"))
        says, quoted, told, last = False, None, False, None  # quoted: the first hit of the open quotation; last: the hit of the clause before
        for k in range(0, len(parts), 2):
            classes = [read(w) for w in _WORD.findall(parts[k])]
            mark = parts[k - 1] if k else ""
            ended, comma = not _ENDS.isdisjoint(mark), "," in mark
            leads = 0 < len(classes) <= 4 and any(c == REPORT for c, _ in classes[:3])
            carried = says and comma and not ended
            if "\n" in mark:
                quoted = None
            if not _QUOTES.isdisjoint(mark):
                if quoted is None:
                    quoted, told = len(hits), says and not ended
                else:
                    if leads:
                        for hit in hits[quoted:]:
                            hit[1] = True
                    quoted = None
            elif leads and comma and not ended and last is not None:
                hits[last][1] = True
            last = None
            if any(c >= THREAT for c, _ in classes):
                last = len(hits)
                hits.append([classes, carried or (quoted is not None and told)])
            if classes:
                n, says = n + len(classes), classes[-1][0] == REPORT
            elif ended:
                says = False
        scores, table_ = [], self.table
        for classes, reported in hits:
            state, total = table_[REPORT][0] if reported else 0, 0.0
            for c, weight in classes:
                state, factor = table_[state + c]
                total += factor * weight
            if total > 0:
                scores.append(total)
        return scores, n

    def features(self, text: str) -> list[float]:
        scores, n = self.clauses(text)
        if not scores:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        return [1.0, max(scores), float(np.log1p(sum(scores))), float(np.log1p(len(scores))), float(np.sqrt(sum(scores) / n))]


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """docs: doc_id, body; labels: doc_id, y. body and y of the documents of at most `most` labels, the first in the order of
    a hash of the id."""
    known = labels.where("doc_id is not null and y is not null").select("doc_id", F.col("y").cast("int").alias("y")).distinct()
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most))  # at most `most` rows of two numbers
    return docs.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("body").alias("body")).select("body", "y")


_SALTS = np.random.default_rng(11).integers(1, 2**63, PLACES, dtype=np.uint64) | np.uint64(1)


def sketch(text: str) -> np.ndarray:
    """MinHash of the text's 5-word shingles, 32 bits a place; zeros for a text without words."""
    hashes = np.unique(shingle_hashes(text, 5))
    out = np.full(PLACES, 0 if not len(hashes) else 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _SALTS
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        out = np.minimum(out, (mixed >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def group_sizes(sketches: np.ndarray) -> np.ndarray:
    """Rows of each row's group of near copies. Rows meet in bands of equal places; each is compared by all places with the
    first rows of its bucket that are not near copies of each other."""
    parent = np.arange(len(sketches))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for band in range(0, PLACES, BAND):
        buckets = defaultdict(list)
        for k, row in enumerate(sketches):
            firsts = buckets[row[band : band + BAND].tobytes()]
            for f in firsts:
                if (sketches[f] == row).mean() >= ALIKE:
                    parent[top(k)] = top(f)
                    break
            else:
                firsts.append(k)
    groups = np.array([top(k) for k in range(len(sketches))], int)
    return np.bincount(groups, minlength=len(groups))[groups]


def learn(rows: DataFrame) -> tuple[Grammar, DataFrame]:
    """rows: body, y; bounded. The seed list with the terms that labels teach, and the rows with their weight."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            yield b.assign(sketch=[sketch(t).tobytes() for t in b["body"]])

    rows = durable(rows.mapInPandas(sketched, "body string, y int, sketch binary"))
    seen = rows.select("y", "sketch").toPandas()  # at most MAX_LABELS rows of 256 bytes
    words, starts = dict.fromkeys(INSULTS, SEED_WEIGHT), {}
    if seen["y"].nunique() < 2:
        return Grammar(words, starts), rows.select("body", "y", F.lit(1.0).alias("weight"))
    bodies = np.frombuffer(b"".join(seen["sketch"]), np.uint32).reshape(len(seen), PLACES)
    share = np.zeros(len(seen))
    for y in (0, 1):
        mine = (seen["y"] == y).to_numpy()
        share[mine] = 1 / group_sizes(bodies[mine])
    bad, good = share[seen["y"] == 1].sum(), share[seen["y"] == 0].sum()
    known = rows.sparkSession.sparkContext.broadcast({(y, xxhash.xxh64_intdigest(s)): w for y, s, w in zip(seen["y"], seen["sketch"], share)})

    def weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            yield b.assign(weight=[known.value[y, xxhash.xxh64_intdigest(s)] for y, s in zip(b["y"], b["sketch"])])[["body", "y", "weight"]]

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())
        for b in filled(batches):
            for text, y, weight in zip(b["body"], b["y"], b["weight"]):
                found = set(_WORD.findall(text.lower()))
                mine = counts[y]
                for t in {f"{w} " for w in found} | {w[:n] for w in found for n in PREFIXES if n < len(w)}:
                    mine[t] += weight
            for y in (0, 1):  # bounded memory
                if len(counts[y]) > 500_000:
                    yield pd.DataFrame({"term": list(counts[y]), "y": y, "n": list(counts[y].values())})
                    counts[y].clear()
        for y in (0, 1):
            if counts[y]:
                yield pd.DataFrame({"term": list(counts[y]), "y": y, "n": list(counts[y].values())})

    rows = rows.mapInPandas(weighted, "body string, y int, weight double")
    found = rows.mapInPandas(terms, "term string, y int, n double").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0.0)).alias("bad"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0.0)).alias("good"))
    found = durable(found.where("bad > 2"))
    limit = float(np.log(max(found.count(), 1)) + 3)
    part, base = F.col("bad") / (F.col("bad") + F.col("good")), float(bad / (bad + good))
    other = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - base))).otherwise(0.0)
    evidence = (F.col("bad") + F.col("good")) * (part * F.log(part / base) + other)
    odds = F.log((F.col("bad") + 0.5) / float(bad + 1)) - F.log((F.col("good") + 0.5) / float(good + 1))
    best = found.select("term", odds.alias("odds"), evidence.alias("evidence")).where((F.col("evidence") > limit) & (F.col("odds") > 1.5))
    for r in best.orderBy(F.desc("evidence"), "term").limit(MAX_TERMS).collect():
        if r["term"].endswith(" "):
            words[r["term"][:-1]] = max(words.get(r["term"][:-1], 0.0), r["odds"])
        else:
            starts[r["term"]] = r["odds"]
    return Grammar(words, starts), rows


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton steps, with a light ridge."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, y. Per document: doc_id, score, clauses (number matched), worst (highest)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    grammar, train = learn(training_rows(rows, labels, max_labels))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            yield pd.DataFrame({"x": [grammar.features(t) for t in b["body"]], "y": b["y"], "weight": b["weight"]})

    seen = train.mapInPandas(features, "x array<double>, y int, weight double").toPandas()  # at most max_labels rows of six numbers
    weights = np.array([-3, 1.0, 0.5, 0.5, 0.5])
    if seen["y"].nunique() > 1:
        weights = fit_logistic(np.vstack(seen["x"]), seen["y"].to_numpy(float), seen["weight"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            x = np.array([grammar.features(t) for t in b["body"]]).reshape(len(b), 5)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p, "clauses": np.rint(np.expm1(x[:, 3])).astype(int), "worst": x[:, 1]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, clauses long, worst double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "clauses", "worst")
