"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits, or several words of 64. Two texts are linked if their fingerprints differ in at most
`max_bits` bits. Fingerprints are cut into segments; each is entered in the table of every segment under all values in
the Hamming ball of radius 1 around its own, so two that differ in at most 2 bits of a segment meet in that table, at a
value between them. Entries are shuffled by the table and the high bits of the value, as many as keep a cell small at the
number of fingerprints; the ball of the low bits is enumerated after the shuffle. What meets in a table is verified by the
complete distance.

With two segments and `max_bits` 4 one segment always differs in at most 2 bits, so no link is lost. For looser
links (`similarity`), the number of segments and their width follow from the number of fingerprints, the similarity
and the share of links that may be missed; see `plan`. There fingerprints are of distinct shingles and only give candidates:
within each loose group the exact Jaccard similarity of the shingle sets decides, and sets are compared that share one of the
rarest shingles of either (as many as two sets this similar cannot both lack). The bits of sets of few shingles scatter more, so
links of such sets are found besides by the subsets they have in common, without loss; see `subset_links`.

Equal fingerprints count once, so a group of exact copies is one row in the tables. In a table's bucket only a spanning
forest of the links is kept, not all pairs; a bucket of more than BUCKET members is cut into blocks and every pair of blocks
is searched, so memory is bounded and no link is lost. Joins that a frequent fingerprint, group or component could make uneven
have two stored sides, so Spark can split their large partitions.

Defined results: null text counts as empty; texts without words have the fingerprint zero. A null id is kept and takes
the component of its text; components are named by the smallest id that is not null. Repeated rows are all returned. Rows with
one id and different texts are each judged by their own text. Very long texts are read whole. Empty tables give empty results.
Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.llm.batches import filled
from sparkloft.llm.components import components
from sparkloft.sources.tables import durable, table

BUCKET, CELL = 2048, 4096
#: Words of a long fingerprint that candidates are compared by.
COMPARED = 8
#: Shingles of a block of a loose group (8 bytes each); lists of sets of at most so many rows are broadcast.
BLOCK, BROADCAST_SETS = 1_000_000, 500_000
#: Sets of at most FEW shingles are joined by their subsets that lack up to LACK of them.
FEW, LACK = 16, 2
#: Standard errors above the mean distance at which a pair of fingerprints is still a candidate.
MARGIN = 4
#: Bits of a segment beyond log2 of the number of fingerprints. A bit more halves the chance meetings, each a row with a whole
#: fingerprint, and takes a tenth more segments, whose rows are short.
SLACK = 11
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of lower-cased (A-Z) words between blanks; of the whole sequence if it is short."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64, len(joined))


def fingerprint(hashes: np.ndarray, length: int = 1) -> bytes:
    """`length` words of 64 bits, high bit first; a bit is 1 if set in over half the hashes. Words after the first are of
    hashes mixed anew."""
    out = []
    for k in range(length):
        h = hashes
        if k:
            h = (h + np.uint64(k * int(_GOLDEN) % 2**64)) * _MIX
            h ^= h >> np.uint64(31)
            h *= _GOLDEN
            h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(bits * 2 > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = 4, length: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (binary, 8 bytes a word) of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(shingle_hashes(t, words), length) for t in b["body"]]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp binary")


def plan(n: int, similarity: float, missed: float = 0.01) -> tuple[int, int, int, int]:
    """Segments, their width, 64-bit words and largest distance for candidates of at least this Jaccard similarity among n
    fingerprints; the distance is MARGIN standard errors above its mean for pairs just similar enough. Width grows with
    log2(n), so that chance meetings in a table stay rare; the number of segments follows from the chance that a pair just
    similar enough differs in at most 2 bits of a segment, and from `missed`."""
    apart = acos(2 * similarity / (1 + similarity)) / pi
    width = max(16, ceil(log2(max(n, 2))) + SLACK)
    ratio = apart / (1 - apart)
    meet = (1 - apart) ** width * (1 + width * ratio + width * (width - 1) / 2 * ratio**2)
    segments = ceil(log(missed) / log(1 - meet))
    length = max(8, ceil(segments * width / 64))
    bits = 64 * min(length, COMPARED)
    return segments, width, length, min(bits, ceil(apart * bits + MARGIN * sqrt(bits * apart * (1 - apart))))


def high_bits(n: int, width: int) -> int:
    """Bits of a segment by which entries are shuffled, so that a cell holds some CELL of n fingerprints, and as many again for
    each bit; the ball of the other bits is enumerated after the shuffle."""
    return max(4, min(width - 8, ceil(log2(max(n, 2) / CELL))))


def entries(fp: bytes, segments: int, width: int, high: int) -> list[tuple[int, int]]:
    """Cell (table and high bits) and low bits of each segment, twice, plus 1 if the low bits' ball is still to be
    enumerated; and the same low bits in the cells one high bit apart."""
    whole, total = int.from_bytes(fp, "big"), 8 * len(fp)
    low = width - high
    out = []
    for s in range(segments):
        value = whole >> (total - (s + 1) * width) & ((1 << width) - 1)
        cell, rest = s << high | value >> low, (value & ((1 << low) - 1)) << 1
        out.append((cell, rest | 1))
        out += [(cell ^ (1 << k), rest) for k in range(high)]
    return out


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Row numbers of links that hold together what is linked, at most one less than there are rows. fps: (n, words)."""
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[u]).sum(axis=1) <= max_bits
            found, left = left[near], left[~near]
            links += [(u, v) for v in found]
            front.extend(found)
    return links


def links(nodes: DataFrame, segments: int, width: int, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """nodes: fp, each once, a short number `n` and `id`. Links a, b (ids) that connect all fingerprints at most max_bits
    apart, as far as their first COMPARED words tell. Table entries hold keys and the short numbers alone; fingerprints are joined
    to what meets. Fingerprints that meet in one table mostly meet in many, so a task joins up what its buckets link and names
    only the smallest id of each; most tasks name the same."""
    high = high_bits(nodes.count(), width)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            for at in range(0, len(b), 2000):
                c = b[at : at + 2000]
                found = np.array([e for fp in c["fp"] for e in entries(fp, segments, width, high)])
                yield pd.DataFrame({"cell": found[:, 0], "low": found[:, 1], "n": np.repeat(c["n"].to_numpy(), len(found) // len(c))})

    low = F.shiftright("low", 1)
    ball = F.array(low, *[low.bitwiseXOR(F.lit(1 << k)) for k in range(width - high)])
    spread = F.explode(F.when(F.col("low") % 2 == 1, ball).otherwise(F.array(low)))
    rows = nodes.mapInPandas(keys, "cell long, low long, n long").repartition("cell").select("cell", spread.alias("low"), "n")
    counted = rows.selectExpr("cell", "low", "n", "count(*) over (partition by cell, low) as members").where("members > 1")
    blocks = F.ceil(F.col("members") / bucket).cast("int")
    mine, other = F.pmod(F.xxhash64("n"), blocks).cast("int"), F.col("other")
    cells = counted.withColumn("blocks", blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("n", "cell", "low", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))
    known = nodes.select("n", "id", F.substring("fp", 1, 8 * COMPARED).alias("fp"))
    lists = cells.join(known, "n").groupBy("cell", "low", "i", "j").agg(F.collect_list("id").alias("ids"), F.collect_list("fp").alias("fps"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            least: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := least.setdefault(x, x)) != x:
                    least[x] = x = least.setdefault(up, up)
                return x

            for ids, fps in zip(b["ids"], b["fps"]):
                fps = list(fps)
                found = np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), -1)
                for u, v in forest(found.astype(np.uint64), max_bits):
                    one, other = top(int(ids[u])), top(int(ids[v]))
                    least[max(one, other)] = min(one, other)
            pairs = [(x, top(x)) for x in list(least)]
            yield pd.DataFrame([(x, y) for x, y in pairs if x != y], columns=["a", "b"], dtype="int64")

    return lists.select("ids", "fps").mapInPandas(search, "a long, b long").distinct()


def near_duplicates(fps: DataFrame, segments: int = 2, width: int = 32, max_bits: int = 4) -> DataFrame:
    """fps: doc_id, fp (kept in the shared folder by the caller). The rows with component_id, the smallest doc_id
    reachable over links."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = durable(nodes.withColumns({"id": F.xxhash64("fp"), "n": F.monotonically_increasing_id()}))
    found = components(links(nodes.select("fp", "n", "id"), segments, width, max_bits))
    named = durable(nodes.join(found, "id", "left").select("fp", "first", F.coalesce("root", "id").alias("root")))
    least = durable(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return fps.join(durable(named.join(least, "root").select("fp", "component_id")), "fp")


def set_of(text: str, words: int) -> tuple[bytes, np.ndarray]:
    """Name (XXH3, 128 bits) of the set of distinct shingle hashes, and the set in order."""
    found = np.unique(shingle_hashes(text, words))
    return xxhash.xxh3_128_digest(found.tobytes()), found


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Row numbers of links that hold together what is linked at this exact Jaccard similarity. Each set is without repeats.

    With shingles in one order, here from the rarest on, two sets this similar have one in common among the first
    size - ceil(similarity * size) + 1 of each. So a set is held against those alone that it meets there, and not against those that have
    been reached. Work grows with what sets have in common that is rare, not with the square of their number."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    counts = np.bincount(ids)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ids = rank[ids]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((ids, owner))
    ids = ids[order]  # each set's from the rarest on
    place = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
    first = np.flatnonzero(place < np.repeat(sizes - np.ceil(similarity * sizes - 1e-9).astype(int) + 1, sizes))
    first = first[np.argsort(ids[first], kind="stable")]
    members, tokens = owner[first], ids[first]
    starts = np.searchsorted(tokens, np.arange(len(counts)))
    held = np.diff(np.append(starts, len(tokens)))  # of the first shingles, how many sets that are still left
    marked, left, links = np.zeros(len(counts), bool), np.ones(len(sets), bool), []
    for start in range(len(sets)):
        front = [start] if left[start] else []
        left[start] = False
        while front:
            u = front.pop()
            mine = ids[ends[u] - sizes[u] : ends[u]]
            met = []
            for t in mine[: sizes[u] - int(np.ceil(similarity * sizes[u] - 1e-9)) + 1]:
                if held[t]:
                    there = members[starts[t] : starts[t] + held[t]]
                    there = there[left[there]]
                    members[starts[t] : starts[t] + len(there)], held[t] = there, len(there)
                    met.append(there)
            met = np.unique(np.concatenate(met)) if met else np.zeros(0, int)
            met = met[(sizes[met] >= similarity * sizes[u] - 1e-9) & (similarity * sizes[met] <= sizes[u] + 1e-9)]
            if not len(met):
                continue
            marked[mine] = True
            at = np.repeat(ends[met] - np.cumsum(sizes[met]), sizes[met]) + np.arange(sizes[met].sum())
            common = np.add.reduceat(marked[ids[at]].astype(np.int64), np.cumsum(sizes[met]) - sizes[met])
            marked[mine] = False
            near = met[common / np.maximum(sizes[met] + sizes[u] - common, 1) >= similarity]
            left[near] = False
            links += [(u, v) for v in near]
            front.extend(near)
    return links


def allowed(common: int, similarity: float) -> int:
    """How many shingles two sets may have besides those in common."""
    return int(common * (1 - similarity) / similarity + 1e-9)


def subset_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links a, b (numbers n) that connect all sets of at most FEW shingles this similar, as far as neither lacks more than LACK of the other's:
    all pairs of at most 14 shingles in all, at 0.8. nodes: n, few (their shingles).

    Each set is entered under each of its subsets that lack up to LACK shingles; two similar sets meet under what they have in common. Of those
    that meet, one that lacks least is linked with every other it may be: two that may be linked may both be linked with it. So there are
    no pairs to look through, and a subset that very many sets share gives a link for each."""

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            out = []
            for n, few in zip(b["n"], b["few"]):
                h = np.frombuffer(few, np.uint64)
                mixed = np.stack([(h ^ (h >> np.uint64(29))) * _GOLDEN, (h ^ (h >> np.uint64(32))) * _MIX], 1)
                mixed = (mixed ^ mixed >> np.uint64(31)) * _MIX
                whole = mixed.sum(0)
                for k in range(LACK + 1):
                    common = len(h) - k
                    if common > 0 and allowed(common, similarity) >= max(k, 1):
                        for gone in combinations(range(len(h)), k):
                            out.append((*(whole - mixed[list(gone)].sum(0)).view(np.int64).tolist(), common, k, n))
            yield pd.DataFrame(out, columns=["one", "two", "common", "lacks", "n"])

    key = ["one", "two", "common"]
    rows = nodes.where(F.length("few") > 0).select("n", "few").mapInPandas(entered, "one long, two long, common int, lacks int, n long")
    least = rows.groupBy(*key).agg(F.min(F.struct("lacks", F.col("n").alias("to"))).alias("least"), F.count("*").alias("members")).where("members > 1")
    most = F.floor(F.col("common") * (1 - similarity) / similarity + 1e-9)
    met = rows.join(durable(least), key).where((F.col("n") != F.col("least.to")) & (F.col("lacks") + F.col("least.lacks") <= most))
    return met.select(F.col("n").alias("a"), F.col("least.to").alias("b")).distinct()


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links a, b (numbers n) that connect all sets of this exact Jaccard similarity within a group. nodes: key, first, size
    and n of each set; groups: n and group. Texts of sets that are not alone in their group are read again. A group of
    more than `block` shingles is cut into blocks and every pair of blocks is searched."""
    nodes = nodes.join(groups, "n")
    several = nodes.groupBy("group").agg(F.count("*").alias("members"), F.ceil(F.sum("size") / block).cast("int").alias("blocks")).where("members > 1")
    several = durable(several)
    asked = durable(nodes.join(several, "group").select("first", "key", "n", "group", F.greatest("blocks", F.lit(1)).alias("blocks")))
    small = asked.count() <= BROADCAST_SETS
    named = asked.where("first is not null").withColumnRenamed("first", "doc_id")
    texts = docs.join(F.broadcast(named) if small else named, "doc_id").drop("doc_id")
    columns = texts.columns

    nameless = asked.where("first is null").drop("first")
    if not nameless.isEmpty():
        texts = texts.unionByName(docs.where("doc_id is null").withColumn("key", set_name(F.col("body"), words)).join(nameless, "key").select(columns))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            for at in range(0, len(b), 500):
                c = b[at : at + 500]
                made = [set_of(t, words) for t in c["body"]]
                c = c.assign(shingles=[x.tobytes() for _, x in made])
                yield c.loc[[k == bytes(x) for (k, _), x in zip(made, c["key"])], ["n", "group", "blocks", "shingles"]]

    sets = texts.mapInPandas(read, "n long, group long, blocks int, shingles binary").dropDuplicates(["n"])
    mine, other = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"), F.col("other")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("n", "shingles", "group", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))
    lists = dealt.groupBy("group", "i", "j").agg(F.collect_list("n").alias("ns"), F.collect_list("shingles").alias("sets")).where(F.size("ns") > 1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            found = [(ns[u], ns[v]) for ns, sets in zip(b["ns"], b["sets"]) for u, v in similar_links([np.frombuffer(x, np.uint64) for x in sets], similarity)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return lists.select("ns", "sets").mapInPandas(search, "a long, b long").distinct()


def similar_sets(docs: DataFrame, words: int = 5, similarity: float = 0.8, missed: float = 0.01) -> DataFrame:
    """docs: doc_id, text. doc_id, key and root of every document: the name of its set of distinct word shingles, and a number
    that the documents of one group have in common, which are linked at this Jaccard similarity. Long fingerprints of the sets
    give loose groups; within these, exact similarity decides. Small sets are linked by their subsets besides."""
    segments, width, length, max_bits = plan(docs.count(), similarity, missed)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            keys, fps, sizes, few = [], [], [], []
            for t in b["body"]:
                key, found = set_of(t, words)
                keys.append(key)
                fps.append(fingerprint(found, length))
                sizes.append(len(found))
                few.append(found.tobytes() if len(found) <= FEW else b"")
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": keys, "fp": fps, "size": sizes, "few": few})

    named = durable(rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, fp binary, size long, few binary"))
    nodes = named.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("few").alias("few"))
    nodes = durable(nodes.withColumn("n", F.monotonically_increasing_id()))
    groups = near_duplicates(nodes.select(F.col("n").alias("doc_id"), "fp"), segments, width, max_bits)
    groups = groups.select(F.col("doc_id").alias("n"), F.col("component_id").alias("group"))
    few, nodes = nodes.select("n", "few"), nodes.drop("fp", "few")
    found = exact_links(rows, nodes, groups, words, similarity).unionByName(subset_links(few, similarity))
    found = components(found).withColumnRenamed("id", "n")
    roots = durable(nodes.join(found, "n", "left").select("key", F.coalesce("root", "n").alias("root")))
    return named.select("doc_id", "key").join(roots, "key")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, missed: float = 0.01) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of every document; see `similar_sets`."""
    sets = durable(similar_sets(docs, words, similarity, missed))
    least = durable(sets.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return sets.join(least, "root").select("doc_id", "component_id")


def set_name(text: Column, words: int = 5) -> Column:
    """The key that `similar_sets` gives a text."""

    def name(texts: pd.Series) -> pd.Series:
        return pd.Series([set_of(t, words)[0] for t in texts], dtype=object)

    return F.pandas_udf(name, "binary")(F.coalesce(text, F.lit("")))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = durable(fingerprints(table(spark, sf_dir, "documents")))
    return near_duplicates(fps).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
