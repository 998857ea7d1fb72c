"""WARC round trips, packing, and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloft.llm import packing, warc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_pages(pages, found):
    """best: the largest id of a payload; none if no page of it has one."""
    best = {}
    for i, _, h in pages:
        best[h or ""] = max((x for x in (best.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in pages:
        raw, first = (h or "").encode(), best[h or ""]
        refers = None if first is None or i == first else first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(want, key=str)
    ordered = [(r.urlkey, r.captured_at, r.page_id is None, r.page_id or 0) for r in sorted(found, key=lambda r: (r.part, r.pos))]
    assert ordered == sorted(ordered)


PAGES = [
    (1, "http://a.com/x", "<p>same</p>"), (2, "http://b.com/", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "http://a.com/x", "line\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://a.com/x\r\ny", "é😀" * 1000), (7, "http://a.com/x", "x" * 3_000_000), (None, "http://n.com", "gone"), (None, "http://n.com", "gone"), (None, "http://n.com", "\r\n"), (2, "http://b.com/", "<p>same</p>"), (2**60 + 1, "http://a.com/big", "own"), (8, "http://c.com:80/", "\r\n"), (9, "http://a.com/x", "\r\n"),
]


@pytest.mark.parametrize("file_bytes, range_rows", [(16 << 20, 100_000), (1, 2), (600, 3)])
def test_archives_round_trip(spark, tmp_path, file_bytes, range_rows, monkeypatch):
    monkeypatch.setattr(warc.merge_runs, "__defaults__", (range_rows,))
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "best", "p", "of", "value", "run")})
    warc.write_archives(rows, f"{tmp_path}/w", file_bytes=file_bytes)
    found = warc.captures(spark, f"{tmp_path}/w").collect()
    check_pages(PAGES, found)
    bodies = {(i, h or "") for i, _, h in PAGES}
    for r in found:  # a record alone, by its offset
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.at)
            raw = warc.parse(gzip.decompress(f.read(r.size)))
        assert raw["warc-type"] == r.record_type and (r.record_type == "revisit" or (r.page_id, raw["block"].decode()) in bodies)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Pages of a megabyte that can't be compressed; whole files are gzip files too."""
    r = random.Random(8)
    rows = [(k, f"http://h{k % 3}.com/{k}", base64.b64encode(r.randbytes(750_000)).decode()) for k in range(20)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"{tmp_path}/w", file_bytes=3 << 20)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(files) >= 6 and all(p.stat().st_size <= (3 << 20) + 1 for p in files)
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC-Record-ID") for p in files) == 20
    check_pages(rows, warc.captures(spark, f"{tmp_path}/w").collect())


def test_damaged_archives_are_refused(spark, tmp_path):
    whole = gzip.compress(warc.record(1, "http://a.com", b"body", None))
    assert [warc.parse(raw)["block"] for _, _, raw in warc.members(whole + b"\0" + whole)] == [b"body", b"body"]
    with pytest.raises(ValueError):
        list(warc.members(whole[:-9]))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")


def test_small_payloads_can_stay_responses(spark, tmp_path):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(rows, f"{tmp_path}/w", least_bytes=5)
    got = {r.page_id: r.record_type for r in warc.captures(spark, f"{tmp_path}/w").collect()}
    assert got[8] == got[9] == got[3] == "response" and got[1] == "revisit"


def test_empty_archives(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.captures(spark, f"{tmp_path}/w").count() == 0


def test_warc_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    check_pages(pages, warc.op7_warc(spark, SMALL).collect())


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randint(0, 20), n) for n in range(r.choice([0, 1, 30]))) for _ in range(k)]
    assert list(warc.loser_tree(runs)) == sorted(x for run in runs for x in run)


def check_packing(docs, found, least_share=0.9):
    tokenizer = Tokenizer.from_file(JSON)
    total, lengths = 0, {}
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in docs.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc.pop(i), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for places in lengths.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert total >= least_share * 1024 * len(lengths)


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_packing(docs, packing.op6_best_fit_packing(spark, SMALL).collect(), 0.95)


def test_packing_odd_rows(spark):
    docs = {1: None, 2: "", 3: "<|endoftext|> and <|", 4: "日本語 текст     ­", 5: "ab " * 40_000, 6: "a" * 5000, 7: "😀 don't 123 \n\n\t x"}
    given = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"piece": F.lit(1), "ids": F.lit(2)})
    check_packing(docs, packing.with_digest(packing.pack(given, JSON, RANKS)).collect(), 0.5)
    assert packing.pack(given.limit(0), JSON, RANKS).count() == 0
    whole = packing.pack(given.where("doc_id = 7"), JSON, RANKS).select(packing.token_ids(F.col("ids")).alias("ids")).first().ids
    assert whole == Tokenizer.from_file(JSON).encode(docs[7], add_special_tokens=False).ids + [2]
    assert packing.pack(given.where("doc_id = 2").unionAll(given.where("doc_id = 2")), JSON).count() == 2


@pytest.mark.parametrize("open_", [4_000_000, 2000])
def test_small_rounds_lose_nothing(spark, monkeypatch, open_):
    monkeypatch.setattr(packing, "ROUND", 3000)
    monkeypatch.setattr(packing, "OPEN", open_)
    monkeypatch.setattr(packing, "GROUP", 50)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_packing(docs, packing.op6_best_fit_packing(spark, SMALL).collect(), 0.85)


def test_rank_library_gives_the_tokenizers_ids():
    full, fast = packing.encoder(JSON), packing.encoder(JSON, RANKS)
    r = random.Random(1)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), 9, 10, 13]]
    texts = ["".join(r.choices(letters, k=200)) for _ in range(300)] + [a + b + a for a in letters for b in "x '\n"]
    assert all(full(t) == fast(t) for t in texts)


def test_sum_of_squares_rule():
    """Each piece goes where the sum of squared counts becomes smallest, as trying all places shows."""
    r = random.Random(2)
    bins, squares = packing.Bins(30), lambda c: int((c[1:30] ** 2).sum())
    for _ in range(400):
        n = r.randint(1, 30)
        options = []
        for gap in [g for g in range(n, 30) if bins.counts[g]] + [30]:
            c = bins.counts.copy()
            if gap < 30:
                c[gap] -= 1
            if gap > n:
                c[gap - n] += 1
            options.append(squares(c))
        bins.place(n)
        assert squares(bins.counts) == min(options)


def test_pipeline(spark, tmp_path):
    """Stages keep clean documents, act on planted ones, and lose none on the way to packing."""
    base = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    item = spark.read.parquet(f"{MIDDLE}/benchmark.parquet").first().text
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    good = base.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' and n_chars between 800 and 3000")
    clean = [r.text for r in good.orderBy("doc_id").limit(3).collect()]
    junk = base.join(labels.where("quality = 0"), "doc_id").orderBy("doc_id").first().text
    planted = [
        (9001, clean[0] + " Unlike all else this closes it"), (9002, clean[1][:400] + " " + item + " " + clean[2][:400]),
        (9003, ". ".join(clean[1].split(". ")[::2] + clean[2].split(". ")[1::2]) + ' token = "abcdef0123456789abcdef0123456789"'), (9004, junk),
    ]
    rows = [(i, t, "en", "src0", len(t)) for i, t in planted]
    docs = base.unionByName(spark.createDataFrame(rows, base.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MIDDLE).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert 9004 not in seen["quality"] and {9001, 9002, 9003} <= seen["quality"].keys()
    assert 9001 not in seen["near_dedup"] and {9002, 9003} <= seen["near_dedup"].keys()
    assert 9002 not in seen["decontamination"] and 9003 in seen["decontamination"]
    assert "abcdef0123" not in seen["secrets"][9003].text and seen["secrets"][9003].n_chars == len(seen["secrets"][9003].text)
    assert seen["secrets"].keys() == seen["decontamination"].keys() == seen["packing"].keys()


def test_stages_with_repeated_and_null_ids(spark, tmp_path):
    """One row of each group stays, whatever ids its rows have; columns may have any names."""
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    text, other = " ".join(f"word{k}" for k in range(100)), "another text altogether"
    rows = [(9001, text), (9001, text), (9001, other), (9000, other), (9001, "a third one"), (None, text), (None, "no id at all"), (None, "no id at all"), (9002, None), (9003, ""),
            (9004, "alone here"), (1, "a one"), (1, "b one"), (2, "c two")]
    given = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], base.schema)
    clashes = "key root rows stays spans cuts blob blocks text_id path _path their_id Their_Blob fp first item_id y stats ids".split()
    wide = given.withColumns({c: F.lit(f"{c}!") for c in clashes}).repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, wide, SMALL).collect()
    want = [(9001, text), (9000, other), (9001, "a third one"), (None, "no id at all"), (9002, None), (9004, "alone here"), (1, "a one"), (1, "b one"), (2, "c two")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r[c] == f"{c}!" for r in got for c in clashes)
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, wide, SMALL).collect()
        assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str) and all(r[c] == f"{c}!" for r in out for c in clashes), name
    assert corpus_pipeline.packing_stage(spark, wide, SMALL).count() == len(rows)
    assert corpus_pipeline.quality_stage(spark, wide.unionByName(base, allowMissingColumns=True), SMALL).count() > 0


def test_stages_judge_texts_of_one_id_each(spark):
    """A leak or a secret in one row of an id leaves the id's other rows alone; very long texts are read whole."""
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    long = "plain words go on " * 60_000
    rows = [(7, long), (7, long + item), (None, item), (None, "no leak"), (8, long + "token=abcdef123"), (8, "token = none of these")]
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], base.schema)
    left = corpus_pipeline.decontamination_stage(spark, given, SMALL).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(i), t) for i, t in [rows[0], rows[3], *rows[4:]])
    out = {(r.doc_id, r.n_chars): r.text for r in corpus_pipeline.secrets_stage(spark, given, SMALL).collect()}
    assert out[8, len(long) + 8] == long + "[secret]" and out[7, len(long)] == long and len(out) == len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
