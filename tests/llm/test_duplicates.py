"""SimHash groups and I-Match fingerprints against brute force and on odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloft.llm import components, imatch, simhash

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """fps: (id, fingerprint) to the smallest id reachable, by comparing all."""
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_query_as_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    want = {(i, f"{f:016x}", g) for (i, f), g in zip(fps, brute_groups(fps))}
    got = simhash.op1_simhash_near_dedup(spark, SMALL).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("bucket", [2, 2048])
def test_links_of_made_fingerprints(spark, bucket, monkeypatch):
    """Chains of fingerprints 1 to 5 bits apart, a crowd around one value, ties and strangers; also with tiny buckets,
    which are searched in blocks."""
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    r = random.Random(3)
    fps = []
    for _ in range(25):
        x = r.getrandbits(64)
        for step in range(5):
            fps.append(x)
            for b in r.sample(range(64), step + 1):
                x ^= 1 << b
    crowd = r.getrandbits(64)
    for _ in range(60):
        x = crowd
        for b in r.sample(range(64), r.randint(0, 3)):
            x ^= 1 << b
        fps.append(x)
    fps += [0, 0, 1, 2**64 - 1]
    rows = [(i, f) for i, f in enumerate(fps)]
    given = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in rows], "doc_id long, fp binary")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(given).collect()}
    assert [got[i] for i, _ in rows] == brute_groups(rows)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (5, "ONE"), (6, "word " * 200_000), (None, "alone here")]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit(1), "id": F.lit(2), "component_id": F.lit(3)})
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(simhash.fingerprints(given)).collect()), key=str)
    want = brute_groups([(i, brute_fingerprint(t)) for i, t in docs])
    assert got == sorted(((i, g) for (i, _), g in zip(docs, want)), key=str)
    assert simhash.near_duplicates(simhash.fingerprints(given.limit(0))).count() == 0


def test_similar_groups(spark):
    """Texts of 300 words with a few words changed are found at a Jaccard similarity over 0.85, strangers are not."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    docs = []
    for g in range(40):
        words = [word() for _ in range(300)]
        docs.append((10 * g, " ".join(words)))
        for c in range(1, 3):
            copy = list(words)
            for k in r.sample(range(300), 3):
                copy[k] = word()
            docs.append((10 * g + c, " ".join(copy)))
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] // 10 == i // 10 for i in got)
    assert sum(got[i] == i // 10 * 10 for i in got) >= 0.95 * len(got)


def shingle_set(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))


def test_similar_groups_are_exact(spark):
    """Pairs just over 0.8 are linked, pairs just under are not, nor are texts that share one line repeated many times."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    docs, pairs = [], {}
    for g in range(80):
        words = [word() for _ in range(300)]
        copy, changed = list(words), 6 if g % 2 else 8
        for k in range(changed):
            copy[20 + 30 * k] = word()
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        pairs[g] = jaccard(docs[-2][1], docs[-1][1])
    line = " ".join(word() for _ in range(14))
    for k in range(200, 204):
        docs.append((k, " ".join([word() for _ in range(150)] + [line] * 40)))
    docs += [(None, docs[3][1]), (None, "own text without a number"), (3, "other text of a repeated number"), (5, docs[5][1])]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.similar_groups(given).collect()
    assert len(rows) == len(docs)
    got = {x.doc_id: x.component_id for x in rows if x.doc_id not in (None, 3)}
    assert all(0.8 <= j < 0.84 if g % 2 else 0.75 < j < 0.8 for g, j in pairs.items())
    assert all(got[2 * g] == got[2 * g + 1] - 1 for g in pairs if g % 2 == 0)
    assert sum(got.get(2 * g + 1, 2 * g) == got[2 * g] for g in pairs if g % 2) >= 39
    assert all(got[k] == k for k in range(200, 204))
    assert sorted((x.component_id for x in rows if x.doc_id is None), key=str) == [2, None]


@pytest.mark.parametrize("block", [1, 700, 250_000])
def test_exact_links_in_blocks(spark, block, monkeypatch):
    """A chain of texts, each like the next but not the one after, is one group however it is cut."""
    monkeypatch.setattr(simhash.exact_links, "__defaults__", (block,))
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    docs = [(k, " ".join(words[15 * k : 15 * k + 150])) for k in range(12)]
    assert jaccard(docs[0][1], docs[1][1]) > 0.8 > jaccard(docs[0][1], docs[2][1])
    got = simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and len(got) == len(docs)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 900), (900, 700), (3, 3)], "a long, b long")
    got = {r.id: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 900: 500, 700: 500}


def brute_lexicon(texts):
    """Words in at least two documents whose inverse document frequency is in the band."""
    df = Counter(w for t in texts for w in set((t or "").lower().split()))
    return {w for w, k in df.items() if k >= 2 and imatch.BAND[0] <= math.log(len(texts) / k) <= imatch.BAND[1]}


def brute_signatures(text, known):
    """Number of terms, and a hash of the sorted terms of each subset, term by term."""
    words = set(text.lower().split())
    hashes = sorted(xxhash.xxh64_intdigest(w) for w in words & known or words)
    out = [len(hashes)]
    for k, rate in enumerate(imatch.RATES):
        seed, kept = xxhash.xxh64_intdigest(f"lexicon {k}") | 1, []
        for h in hashes:
            x = h * seed % 2**64
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            if (x ^ x >> 32) <= min(int(rate * 2**64), 2**64 - 1):
                kept.append(h)
        out.append((xxhash.xxh32_intdigest(b"".join(h.to_bytes(8, "little") for h in kept)) or 1) if kept else 0)
    return out


def brute_likeness(a, b):
    """The likeliest share of terms in common, signature by signature."""
    if a == b:
        return 1.0
    both, shares = a[0] + b[0], []
    for k in range(40):
        d = max((1 - k / 40) * both, 1, abs(a[0] - b[0]))
        logs = [(d * math.log1p(-min(p, 1 - 1e-9)), x == y) for p, x, y in zip(imatch.RATES, a[1:], b[1:])]
        shares.append((sum(min(q, -1e-12) if same else math.log(-math.expm1(min(q, -1e-12))) for q, same in logs), 1 - d / both))
    return max(shares, key=lambda x: x[0])[1]


def test_imatch_query_as_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    known = brute_lexicon([t for _, t in docs])
    got = {r.doc_id: r for r in imatch.op4_imatch_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(docs)
    text_of = lambda sig: "".join(f"{x:08x}" for x in sig)
    for k, (i, text) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        mine, other, next_ = (brute_signatures(t, known) for t in (text, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(mine), text_of(other))
        assert abs(r.near_edited - brute_likeness(mine, other)) < 1e-9 and abs(r.near_next - brute_likeness(mine, next_)) < 1e-9
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95 and np.mean([r.near_edited for r in got.values()]) > 0.6


def test_likeness_estimates_common_terms():
    r = np.random.default_rng(3)
    for size in (10, 100, 3000):
        for common in (0.0, 0.6, 0.9):
            found = []
            for _ in range(60):
                a, b = r.integers(0, 2**63, size).astype(np.uint64), r.integers(0, 2**63, size).astype(np.uint64)
                b[: int(common * size)] = a[: int(common * size)]
                found.append(imatch.likeness(*(imatch.signatures(np.sort(x), np.zeros(0, np.uint64)) for x in (a, b))))
            assert abs(np.mean(found) - common) < 0.15, (size, common, np.mean(found))


def test_imatch_in_ranges(spark):
    """Many small ranges give what one range gives, also for odd rows; every row is there."""
    docs = [(k * 7, f"term{k % 5} term{k % 11} word{k} é😀 " * (k % 4)) for k in range(60)]
    docs += [(3, None), (5, ""), (7, "x"), (7, "x"), (7, "y"), (None, "no id"), (None, "no id"), (None, None), (2**60 + 1, "large"), (-4, "term1 " * 100_000)]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "part": F.lit(2), "tail": F.lit(3), "h": F.lit(4)})
    given = given.withColumn("body", F.coalesce("text", F.lit("")))
    known = imatch.lexicon_parts(given, "body")
    one = sorted(map(tuple, imatch.follow(given, known).collect()), key=str)
    many = sorted(map(tuple, imatch.follow(given, known, per_part=5).collect()), key=str)
    assert one == many and sorted(r[0] for r in one if r[0] is not None) == sorted(i for i, _ in docs if i is not None) and len(one) == len(docs)
    assert imatch.follow(given.limit(0), known).count() == 0 and len(imatch.lexicon(given.limit(0), "body")) == 0
    alone = imatch.follow(given.where("doc_id = 3"), known).first()
    assert alone.near_next == 1 and alone.n_chars == 0


def test_ranges(spark):
    for cuts in ([], [5], [-3, 0, 7, 8, 100], list(range(0, 500, 7))):
        got = spark.range(-10, 520).select("id", imatch.range_of(F.col("id"), cuts).alias("part")).collect()
        assert all(r.part == sum(c <= r.id for c in cuts) for r in got)


def test_lexicon_is_the_band(spark):
    texts = [f"every w{k % 3} own{k} t{k // 30}" for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for band in ((0.5, 10.8), (0.0, 1.0), (3.0, 10.8)):
        df = Counter(w for t in texts for w in set(t.split()))
        want = {w for w, k in df.items() if k >= 2 and band[0] <= math.log(90 / k) <= band[1]}
        assert set(imatch.lexicon(docs, band=band).tolist()) == {xxhash.xxh64_intdigest(w) for w in want}
    cut = [imatch.loaded(p).tolist() for p in imatch.lexicon_parts(docs, band=(0.0, 5.0), most=3)]
    assert len(cut) > 2 and sorted(sum(cut, [])) == imatch.lexicon(docs, band=(0.0, 5.0)).tolist()


@pytest.mark.parametrize("most", [1, 40, 2000])
def test_lexicons_in_parts_give_the_same(spark, most):
    """Beyond what is sent to a task at once: the whole query's rows, also of texts without a term in the band and without any."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 7 < 2" if most < 2000 else "true").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    docs = docs.unionByName(spark.createDataFrame([(9001, ""), (9002, "zzzz yyyy"), (None, "a b"), (9003, "x " * 50_000)], "doc_id long, body string"))
    band = (0.0, 1.2) if most == 1 else imatch.BAND
    whole, parts = imatch.lexicon_parts(docs, "body", band), imatch.lexicon_parts(docs, "body", band, most=most)
    assert len(whole) == 1 and len(parts) > 1
    assert sorted(map(tuple, imatch.follow(docs, parts).collect()), key=str) == sorted(map(tuple, imatch.follow(docs, whole).collect()), key=str)


def test_recall_of_planted_pairs(spark):
    """Of pairs at 0.8 or more, nearly all are linked; none below; over the whole range of similarities and lengths."""
    r = random.Random(13)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    docs, found = [], {}
    for g in range(400):
        words = [word() for _ in range(r.choice([60, 150, 400]))]
        copy = list(words)
        for _ in range(max(1, round(len(words) * r.uniform(0.005, 0.03)))):
            copy[r.randrange(len(words))] = word()
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        found[g] = jaccard(docs[-2][1], docs[-1][1])
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = {g: got[2 * g + 1] == 2 * g for g in found}
    near, clear = [g for g in found if 0.8 <= found[g] < 0.85], [g for g in found if found[g] >= 0.85]
    assert len(near) > 30 and len(clear) > 60
    assert np.mean([linked[g] for g in near]) >= 0.95 and all(linked[g] for g in clear)
    assert not any(linked[g] for g in found if found[g] < 0.8)


def test_cells_grow_with_the_fingerprints():
    """High bits follow the number of fingerprints, so a cell stays small; entries name the same values however they are cut."""
    assert [simhash.high_bits(n, 32) for n in (1, 10**5, 10**9, 10**12)] == [4, 5, 18, 24]
    fp = bytes.fromhex("0123456789abcdef")
    for high in (4, 9, 24):
        values = set()
        for cell, low in simhash.entries(fp, 2, 32, high):
            ball = [low >> 1] + ([low >> 1 ^ 1 << k for k in range(32 - high)] if low & 1 else [])
            values |= {(cell >> high, (cell & (1 << high) - 1) << 32 - high | x) for x in ball}
        whole = [0x01234567, 0x89ABCDEF]
        assert values == {(s, v ^ x) for s, v in enumerate(whole) for x in [0, *(1 << k for k in range(32))]}


def short_pair(word, n, more, changed):
    """A text of n shingles of five words, and one with `more` words behind it and `changed` first words of its own."""
    words = [word() for _ in range(n + 4)]
    return " ".join(words), " ".join([word() for _ in range(changed)] + words[changed:] + [word() for _ in range(more)])


def test_recall_of_short_texts(spark):
    """Pairs just at 0.8 or above, of 1 shingle up: all pairs of up to 14 shingles together are found, of others nearly all; none below."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghij", k=8))
    docs, kinds = [], []
    for n in range(1, 48):
        for _ in range(30 if n < 12 else 12):
            most = max(n // 4, 1)
            more = r.choice([most, most + 1, r.randrange(0, most + 1)])
            a, b = short_pair(word, n, more, 0 if n < 9 or r.random() < 0.5 else 1)
            kinds.append((jaccard(a, b), len(shingle_set(a) | shingle_set(b)), a == b))
            docs += [(len(docs), a), (len(docs) + 1, b)]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(len(kinds))]
    assert not any(x for x, (j, _, _) in zip(linked, kinds) if j < 0.8)
    small = [x for x, (j, size, same) in zip(linked, kinds) if j >= 0.8 and size <= 14 and not same]
    larger = [x for x, (j, size, same) in zip(linked, kinds) if j >= 0.8 and size > 14 and not same]
    assert len(small) > 60 and all(small), (len(small), sum(small))
    assert len(larger) > 150 and np.mean(larger) >= 0.98, (len(larger), sum(larger))


def linked_as(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def brute_links(sets, similarity):
    return [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]


def varied_sets(r, groups, n, largest):
    bases = [{r.randrange(10**6) for _ in range(r.randrange(1, largest))} for _ in range(groups)]
    out = set()
    for _ in range(n):
        x = set(r.choice(bases))
        for _ in range(r.randrange(6)):
            if r.random() < 0.5 and len(x) > 1:
                x.discard(r.choice(sorted(x)))
            else:
                x.add(r.randrange(40))
        out.add(tuple(sorted(x)))
    return [set(x) for x in sorted(out)]


def test_links_of_sets_as_all_pairs():
    r = random.Random(19)
    for largest in (6, 20, 60):
        for _ in range(15):
            sets = varied_sets(r, 5, 40, largest)
            got = linked_as(len(sets), simhash.similar_links([np.array(sorted(x), np.uint64) for x in sets], 0.8))
            want = linked_as(len(sets), brute_links(sets, 0.8))
            assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_subset_links_as_all_pairs(spark):
    """Small sets, also a crowd that differs in one shingle each: the same groups as from all pairs, without a loss up to 14 in all."""
    r = random.Random(23)
    sets = varied_sets(r, 12, 250, 15) + [set(range(500, 510)) | {k} for k in range(600, 700)] + [set(range(800, 804)), set(range(800, 805)), {1}, {2}]
    sets = [set(x) for x in sorted({tuple(sorted(x)) for x in sets if len(x) <= simhash.FEW})]
    rows = [(k, np.array(sorted(x), np.uint64).tobytes()) for k, x in enumerate(sets)] + [(9999, b"")]
    found = [(x.a, x.b) for x in simhash.subset_links(spark.createDataFrame(rows, "n long, few binary").repartition(4), 0.8).collect()]
    near = set(brute_links(sets, 0.8))
    assert all((max(p), min(p)) in near for p in found) and len(found) < 4 * len(sets)
    got, want = linked_as(len(sets), found), linked_as(len(sets), [(a, b) for a, b in near if len(sets[a] | sets[b]) <= 14])
    assert all(got[a] == got[b] for a, b in near if len(sets[a] | sets[b]) <= 14) and len(set(zip(got, want))) == len(set(want))


def test_loose_chains_and_templates_are_linear():
    """20,000 texts each at 0.7 to the next, or all of one template: no pairs of all with all."""
    r = np.random.default_rng(29)
    words, frame = r.integers(0, 2**62, 17 * 20_000 + 96).astype(np.uint64), r.integers(0, 2**62, 70).astype(np.uint64)
    began = time.process_time()
    assert simhash.similar_links([np.unique(words[17 * k : 17 * k + 96]) for k in range(20_000)], 0.8) == []
    assert simhash.similar_links([np.unique(np.concatenate([frame, r.integers(0, 2**62, 26).astype(np.uint64)])) for _ in range(20_000)], 0.8) == []
    assert time.process_time() - began < 60
