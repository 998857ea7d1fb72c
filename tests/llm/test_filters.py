"""URL filters, secret scans, decontamination: against brute force and on odd rows."""

import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloft.llm import decontaminate, secret_scans, url_filters
from sparkloft.llm.oracle import ORACLE_SQL

SMALL = "/root/testdata/sf0.001"


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "example.com/en/7", "http://", "https://Example.COM/en/71?x", "http://a.example.com/en/6", "http://b.net/de/8", "http://example.net/de/8#t",
    "http://notexample.net/de/80", "ftp://x.org/es/", "http://org/es/1", "http://xorg/es/1", "http://q.org?/es/", "a://b://c/d", "http://h\n/en/\nx", "http://com/en/",
    "http://É.com/EN/", "http://u:p@h.com:80/en/",
]


def test_hosts_paths_and_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "_host", "_path", "Path", "row", "_verdict", "bad", "domain")})
    got = {r.page_id: r for r in url_filters.filter_urls(rows, F.lit(0)).collect()}
    for k, url in enumerate(URLS):
        host, path = brute_host_path(url)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, *want), url
        assert {got[k][c] for c in ('_host', '_path', 'row', '_verdict', 'bad', 'domain')} == {'clash'}


def test_reputation_shrinks(spark):
    """One bad page tells little; hundreds tell all; a new host leans on its domain."""
    rows = [("big.spam.com", 1)] * 300 + [("small.spam.com", 1)] * 2 + [("new.spam.com", None)] + [("ok.fine.com", 0)] * 300 + [("odd.fine.com", 1)]
    known = {r.host: r for r in url_filters.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert known["big.spam.com"].lower > 0.9 and known["ok.fine.com"].upper < 0.1
    assert known["new.spam.com"].bad_rate > known["odd.fine.com"].bad_rate
    assert known["odd.fine.com"].lower < 0.5
    assert all(0 <= r.lower <= r.bad_rate <= r.upper <= 1 for r in known.values())
    assert url_filters.reputation(spark.createDataFrame([], "host string, bad int")).count() == 0


def test_page_outcomes(spark):
    """Of the visible text alone; long runs of open brackets take linear time."""
    pages = [None, "", "<p>clean text</p>", "<p>a$b%c</p>", "<a title='$$$$'>plain</a>", "<" * 10**6, "x" * 60 + "<!!>" + "!"]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    got = {r.k: r.o for r in rows.select("k", url_filters.page_outcome(F.col("html")).alias("o")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}


def test_url_query(spark):
    got = url_filters.op3_url_filters(spark, SMALL).toPandas()
    assert len(got) == 50 and set(got["verdict"]) <= {"allow", "block"}


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_spans(text):
    found = []
    for no, (kind, pattern, group, least) in enumerate([("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        found += [(m.start(), no, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(found))


TEXTS = [
    None, "", "token", "token=abcdef", "Token: 'abc'", "é😀 PASSWORD = \"hunter2x\" api_key:abcdef1", "secret:token : abcdefg", "token:secret:abcdefgh",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 16, "a" * 23, "a" * 24, "apikey=" + "0" * 30, "token==abcdef==token=ghijkl",
    "passwd  =  x.y-z_/+ token=abcdef", "token=abcdef\ntoken=abcdef", "ſecret=abcdef toKen=abcdef", "key=abcdefg", "x" * 300_000 + " token=abcdefg " + "y" * 300_000,
]


def test_spans(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "token=abcdef"), (3, TEXTS[3])], "doc_id long, text string").withColumn("spans", F.lit(1))
    found = secret_scans.scan_incremental(rows, f"{tmp_path}/ledger").collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = TEXTS[r.path] if r.path is not None else "token=abcdef"
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in secret_scans.BASE_KINDS)
        assert base == brute_spans(text or ""), text[:80]
        assert r.blob == hashlib.sha256((text or "").encode()).hexdigest()


def test_ledger_scans_each_blob_once(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "none")], "doc_id long, text string")
    secret_scans.scan_incremental(docs, ledger).collect()
    assert spark.read.parquet(f"{ledger}/blobs").count() == 2
    more = docs.unionByName(spark.createDataFrame([(4, "secret=123456"), (5, "none")], docs.schema))
    got = {r.path: len(r.spans) for r in secret_scans.scan_incremental(more, ledger).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    assert spark.read.parquet(f"{ledger}/blobs").count() == 3 and spark.read.parquet(f"{ledger}/findings").count() == 2
    secret_scans.scan_incremental(docs, ledger, rule_version="next").collect()
    assert spark.read.parquet(f"{ledger}/blobs").count() == 5
    assert secret_scans.scan_incremental(docs.limit(0), f"{tmp_path}/other").count() == 0


def brute_cuts(spans):
    out = []
    for a, z in sorted((s.start, s.end) for s in spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def test_redaction(spark, tmp_path):
    jwt = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    texts = TEXTS + ["é token=abcdef and " + "b" * 30 + " secret='" + "c" * 30 + "' end", "plain", f"{jwt} x{jwt} {jwt}.d token={jwt}", "é" * 1023 + " token=abcdef" + "😀" * 2050 + "f" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scans.scan_incremental(rows, f"{tmp_path}/ledger")
    laid = found.join(rows, F.col("path") == F.col("doc_id")).select("doc_id", "text", "spans", "cuts", secret_scans.blocks_of(F.coalesce("text", F.lit(""))).alias("blocks"))
    for r in laid.withColumn("out", secret_scans.redact(F.col("blocks"), F.col("cuts"))).where("size(cuts) > 0").collect():
        cuts, at, want = brute_cuts(r.spans), 0, ""
        assert [list(c) for c in r.cuts] == cuts
        for a, z in cuts:
            want, at = want + r.text[at:a] + "[secret]", z
        assert r.out == want + r.text[at:]
    kinds = {r.path: [(s.kind, s.start) for s in r.spans] for r in found.collect()}
    assert [k for k in kinds[len(TEXTS) + 2] if k[0] == "jwt"] == [("jwt", 0), ("jwt", 85), ("jwt", 135)]


def test_long_texts_take_linear_work(spark, tmp_path):
    """A megabyte of dots, of token beginnings, and a hundred thousand secrets, each in seconds."""
    many = "".join(f"token=secret{k:06d} " for k in range(100_000))
    texts = ["." * 10**6, "eyJ" * 333_333, "-eyJ" * 250_000, "-----BEGIN " * 90_000, "token " * 160_000, many, "1," * 500_000, "gh" * 500_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.path: r.n for r in secret_scans.scan_incremental(rows, f"{tmp_path}/ledger").selectExpr("path", "size(spans) as n").collect()}
    assert got == dict.fromkeys(range(8), 0) | {5: 100_000}
    docs = spark.createDataFrame([(5, many, "en", "s", len(many))], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.secrets_stage(spark, docs, "").first()
    assert out.text == "[secret] " * 100_000 and out.n_chars == len(out.text)
    items = spark.createDataFrame([(1, "What is the capital of France in the year of the great fire?")], "item_id long, text string")
    assert decontaminate.leaks(rows, items).count() == 0
    assert time.time() - began < 90


def brute_leaks(docs, items, size=8, least=6):
    """Verbatim leaks: items of which `least` windows, or half of all, stand in the document on one alignment."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            total = len(v) - size + 1
            shifts = {}
            for p in range(len(w) - size + 1):
                for q in range(total):
                    if w[p : p + size] == v[q : q + size]:
                        shifts.setdefault(p - q, set()).add(q)
            if total > 0 and any(len(s) >= least or 2 * len(s) >= total for s in shifts.values()):
                out.add((d, i))
    return out


ITEMS = [
    (1, "A train leaves Boston at 30 km and arrives in Denver after 5 hours so how far is the way from Boston to Denver in total"),
    (2, "the quick brown fox jumps over the lazy dog while the cat sleeps on the warm mat"),
    (3, "short item"), (4, None),
]


def test_leaks(spark):
    filler = "one more plain sentence of words that mean nothing here "
    docs = [
        (1, filler + ITEMS[1][1] + ". " + filler),
        (2, filler + "a train leaves Chicago at 45 miles and arrives in Dallas after 7 hours so how far is the way from Chicago to Dallas in total"),
        (3, filler + "a train leaves Chicago at 45 miles and arrives in Dallas after 7 hours so how far is the way from Austin to Miami in total"),
        (4, filler * 30), (5, ""), (6, None), (7, "the quick brown fox jumps over the lazy"), (8, (filler * 2000) + ITEMS[1][1].upper()),
        (9, "The*** quick### brown!! fox&& jumps%% over$$ the** lazy## dog!! while the cat sleeps, on the warm mat"), (None, ITEMS[1][1]), (1, filler + ITEMS[1][1]),
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(rows, items).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {(1, 2), (2, 1), (8, 2), (9, 2), (None, 2)}
    assert got[2, 1].kind == "reparameterised" and got[3, 1].kind == "inconsistent" and got[1, 2].kind == "verbatim"
    assert decontaminate.leaks(rows.limit(0), items).count() == 0 and decontaminate.leaks(rows, items.limit(0)).count() == 0


def test_leaks_as_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = decontaminate.op2_decontamination(spark, SMALL).where("contaminated").select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == brute_leaks(docs, items)


@pytest.mark.parametrize("limit", [0])
def test_large_benchmarks_join_by_shuffle(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs, items = spark.createDataFrame([(1, ITEMS[1][1])], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.leaks(docs, items).where("contaminated").count() == 1


def contaminated(spark, texts, items):
    """Pairs of places in the two lists."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, items).where("contaminated").collect()}


def test_leaks_of_slot_rich_and_short_items(spark):
    sums = "Compute 12 + 7 - 3 * 5 + 8 / 2 - 9 + 14 * 6 - 11 + 20"
    items = [sums, "What is the capital of France?", "Name one prime"]
    texts = [
        f"Some words before. {sums} and some after", "He asked: what is the CAPITAL of France? Paris.", "What is the capital of Spain? Paris.",
        "Compute 1 + 2 - 4 * 6 + 7 / 3 - 8 + 15 * 9 - 10 + 21", "name one prime", "name one", "the capital of France",
    ]
    assert contaminated(spark, texts, items) == {(0, 0): "verbatim", (1, 1): "verbatim", (4, 2): "verbatim"}


def test_leaks_of_names_and_cases(spark):
    alice = "Alice has 3 apples. Alice buys 5 more apples. How many apples does Alice have?"
    anna = "Anna has 12 red marbles. Ben has 7 blue marbles. How many marbles do both have in the end?"
    dense = "Yesterday Carl met Dora and Emil near Fulda where Gerd and Hans sold Irma nine of the old maps that Jana drew in Kiel"
    texts = [
        "First. Bob has 4 apples. Bob buys 9 more apples. How many apples does Bob have?", "Bob has 4 apples. Carl buys 9 more apples. How many apples does Dan have?",
        "Rosa has 15 red marbles. Theo has 4 blue marbles. How many marbles do both have in the end?", dense.lower(), dense.title(), dense.upper(), anna.title(),
    ]
    got = contaminated(spark, texts, [alice, anna, dense])
    assert got == {(0, 0): "reparameterised", (2, 1): "reparameterised", (3, 2): "verbatim", (4, 2): "verbatim", (5, 2): "verbatim", (6, 1): "verbatim"}


def test_leaks_of_repeated_ids(spark):
    """Rows of one id are judged each; what an id gets does not depend on their order or partitions."""
    filler = "one more plain sentence of words that mean nothing here "
    docs = [(1, filler), (1, filler + ITEMS[1][1]), (1, "a train leaves Chicago at 45 miles and arrives in Dallas after 7 hours so how far is the way from Chicago to Dallas in total")] * 3
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for order, parts in ((docs, 1), (docs[::-1], 5)):
        rows = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        got = [(r.doc_id, r.item_id, r.kind, r.contaminated) for r in decontaminate.leaks(rows, items).collect()]
        assert sorted(got) == [(1, 1, "reparameterised", True), (1, 2, "verbatim", True)]
        assert decontaminate.leaks_by_text(rows, items).where("contaminated").select("text_id").distinct().count() == 2


def test_only_matched_texts_are_tokenised_again(spark):
    """Texts are held against the matched hashes before they are stored; only what is stored is tokenised."""
    rows = spark.createDataFrame([(k, f"some words of text number {k}") for k in range(50)] + [(99, ITEMS[0][1])] * 3, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.durable(decontaminate.matches(rows, items))
    kept, before = [], decontaminate.durable
    decontaminate.durable = lambda df: kept.append(before(df)) or kept[-1]
    try:
        decontaminate.slot_values(found, rows, items)
    finally:
        decontaminate.durable = before
    assert [k.count() for k in kept if "text" in k.columns] == [1]


def test_reparameterised_leaks_as_sql(spark, tmp_path):
    """The whole query over planted copies, re-parameterised and inconsistent ones, against its SQL."""
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = "yesterday a train left {} at {} km and came to {} after {} hours so how far is it from {} to {} in all told"
    made = [item.format(a, n, b, m, a2, b2) for a, n, b, m, a2, b2 in (
        ("Boston", 30, "Denver", 5, "Boston", "Denver"), ("Chicago", 45, "Dallas", 7, "Chicago", "Dallas"), ("Boston", 30, "Denver", 5, "Austin", "Miami"))]
    rows = [(90_000 + k, f"some words go before {t} and some go after", "en", "s", len(t)) for k, t in enumerate(made)]
    base.unionByName(spark.createDataFrame(rows, base.schema)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items.unionByName(spark.createDataFrame([(9000, made[0])], items.schema)).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op2_decontamination(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kind for r in got if r.item_id == 9000} == {90_000: "verbatim", 90_001: "reparameterised", 90_002: "inconsistent"}
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = c.execute(ORACLE_SQL["op2_decontamination"])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(found.fetchall())


def test_shared_instructions_are_no_leak(spark):
    """What many items share (one sentence, or 15 words before each question) makes neither a leak nor a row; an item in full beside
    it is found, as is one that has no other words."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    own = [" ".join(word() for _ in range(18)) for _ in range(40)]
    for shared in ("choose the one best answer from the list below", "read the text with care and then choose the one best answer from the list below"):
        items = [f"{shared} {x}" for x in own]
        texts = [f"{' '.join(word() for _ in range(12))} {shared} {' '.join(word() for _ in range(9))}" for _ in range(60)] + [f"see {items[7]}", own[9]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        given = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        got = {(x.doc_id, x.item_id): x.contaminated for x in decontaminate.leaks(docs, given).collect()}
        assert got == {(60, 7): True, (61, 9): True}
    same = ["state in your own words what the whole of the story above tells us"] * 8
    assert contaminated(spark, [f"please {same[0]} again", same[0].replace("tells us", "says")], same) == {(0, k): "verbatim" for k in range(8)}


def test_different_names_stay_different(spark):
    item = "Then Alice gave Bob 3 of the red books and Bob gave Alice the map that Alice and Bob had found"
    texts = [item.replace("Alice", "Carl").replace("Bob", "Dora"), item.replace("Alice", "Carl").replace("Bob", "Carl"), item.replace("3", "seven")]
    assert contaminated(spark, texts, [item]) == {(0, 0): "reparameterised", (2, 0): "reparameterised"}


def test_number_words_are_numbers(spark):
    item = "A baker fills 12 trays with 30 rolls each and sells 45 of the rolls before noon so how many are left"
    texts = [item.replace("12", "twelve").replace("30", "thirty").replace("45", "ninety"), item.replace("12", "seven").replace("45", "8")]
    assert contaminated(spark, texts, [item]) == {(0, 0): "reparameterised", (1, 0): "reparameterised"}
