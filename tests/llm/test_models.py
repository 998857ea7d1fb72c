"""Quality, toxicity and licence classifiers: accuracy on held-out rows, and odd rows."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloft.llm import licenses, quality, toxicity

MIDDLE = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (None, "Null id."), (5, "word " * 100_000), (6, "😀 é\n\n!!")]


def known(spark, column, sf_dir=MIDDLE):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def test_quality_held_out(spark):
    got = quality.op9_quality_classifier(spark, MIDDLE).toPandas()
    labels = known(spark, "quality")
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    out = got[got["held_out"] & got["doc_id"].isin(labels)]
    assert (out["predicted"] == out["doc_id"].map(labels)).mean() > 0.97


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"stats": F.lit(1), "score": F.lit(2)})
    stats = quality.statistics(docs)
    labels = spark.createDataFrame([(4, 1), (5, 0), (3, None), (99, 1)], "doc_id long, y int")
    got = quality.score(stats, quality.fit(stats, labels, features=8)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(stats, labels.limit(0)) is None
    assert {r.score for r in quality.score(stats, None).collect()} == {0.5}
    assert quality.score(quality.statistics(docs.limit(0)), None).count() == 0


def test_normal_equations_as_whole(spark):
    """Sums over partitions give what one least-squares fit gives."""
    r = np.random.default_rng(1)
    x, y = r.normal(size=(200, quality.N_STATS)), r.integers(0, 2, 200).astype(float)
    shift, scale = np.zeros(quality.N_STATS), np.ones(quality.N_STATS)
    rows = spark.createDataFrame([(a.tolist(), float(b), k % 2) for k, (a, b) in enumerate(zip(x, y))], "stats array<double>, y double, fold int").repartition(7)
    total = sum(quality.normal_equations(rows, shift, scale, 8).values())
    z = quality.fourier(x, shift, scale, 8)
    assert np.allclose(total, z.T @ np.hstack([z, y[:, None]]))


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(2)
    x = r.normal(size=(20, quality.N_STATS))
    z = quality.fourier(x, np.zeros(quality.N_STATS), np.ones(quality.N_STATS), 20_000)[:, 1:]
    gaps = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-gaps / 2 / quality.BANDWIDTH**2)).max() < 0.05


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.full(6, 100.0), np.array([0, 30, 20, 50, 100, 90]))
    assert x == sorted(x) and y == sorted(y) and len(x) == 4 and 0 < y[0] and y[-1] < 1


def test_toxicity_held_out(spark):
    got = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = known(spark, "toxic", "/root/testdata/sf0.1")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    out = got[got["held_out"] & got["doc_id"].isin(labels)]
    truth = out["doc_id"].map(labels)
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert out["predicted"][truth == 1].mean() > 0.85 and out["predicted"][truth == 0].mean() < 0.02


@pytest.mark.parametrize(
    "low, high",
    [
        ("what a nice day", "what an idiot"),
        ("this is not a idiot", "this is an idiot"),
        ("she said idiot", "well then idiot"),
        ("the idiot ran", "you idiot ran"),
        ("we kill time. you know", "i will kill you"),
        ("an idiot", "an idiot, a moron"),
    ],
)
def test_grammar_weighs_clauses(low, high):
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 3.0), {"blarg": 2.0})
    total = lambda t: sum(g.clauses(t)[0])
    assert total(low) < total(high)
    assert total("blargish") == 2.0 and total("blarg") == 0.0 and total("IDIOT!") == 3.0


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, y int")
    for some in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(docs, some).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_licenses_found(spark):
    lines = {t: f for f, ts in licenses.TEMPLATES.items() for t in ts} | {t: None for t in licenses.UNLICENSED}
    lines |= {"RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!": "mit", "the zork license of 1920": None, "Licence": None}
    lines |= {"This was not released under the MIT License.": None, "The code is no longer licensed under the Apache License, Version 2.0.": None, "Licensed under CC BY 3.0.": "cc-by"}
    docs = [(k, f"Some text above.\n{t}\nand below.") for k, t in enumerate(lines)] + ODD
    given = spark.createDataFrame([(None if i is None else i + 1000 * (i < 7 and t is not None and "above" not in t), t) for i, t in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(given.withColumn("family", F.lit("x")), licenses.Classifier()).collect()}
    for k, (line, family) in enumerate(lines.items()):
        assert (got[k].family if k in got else None) == family, line
        assert family is None or (got[k].paragraph, got[k].line) == (1, line)
    assert licenses.scan_licenses(given.limit(0), licenses.Classifier()).count() == 0


def test_license_query(spark):
    """Every document with a licence line, and no other."""
    got = {r.doc_id: r.families for r in licenses.op8_license_scan(spark, MIDDLE).collect()}
    docs = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(bool(got[i]) == ("license" in t or "cc by-nc" in t) for i, t in docs.items())


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT_GRANT = """ * Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software and associated documentation files"""


def test_licenses_wrapped_over_lines(spark):
    long = "one more plain sentence of words " * 40
    docs = [(1, GPL_HEADER), (2, f"first line\n\n{MIT_GRANT}\n\nlast"), (3, f"{MIT_GRANT}\n *\n{GPL_HEADER}"),
            (4, long + " ".join(MIT_GRANT.replace("*", "").split()) + " " + long), (5, MIT_GRANT.replace("\n", "\n\n")), (6, None)]
    found = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), licenses.Classifier()).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [(1, 0, "gpl"), (2, 2, "mit"), (3, 0, "mit"), (3, 3, "gpl"), (4, 0, "mit")]


def test_composed_grammar_as_stepwise():
    """The composed transducer does what running the five in turn does."""
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.target(), toxicity.threat(), toxicity.insult()]
    whole = parts[0]
    for t in parts[1:]:
        whole = toxicity.compose(whole, t)
    table, n = toxicity.grammar_table()
    r = np.random.default_rng(4)
    for _ in range(500):
        symbols = [int(s) for s in r.choice(toxicity.CLASSES, r.integers(0, 12))]
        stream, factors, state, got = symbols, np.ones(len(symbols)), 0, []
        for t in parts:
            out = t.run(stream)
            stream, factors = [s for s, _ in out], factors * [f for _, f in out]
        assert [s for s, _ in whole.run(symbols)] == stream and np.allclose([f for _, f in whole.run(symbols)], factors)
        for s in symbols:
            state, factor = table[state + s]
            got.append(factor)
        assert np.allclose(got, [f if s in (toxicity.INSULTED, toxicity.THREATENED) else 0 for s, f in zip(stream, factors)])
    assert n == len({s for s, _ in whole.arcs})


def test_harmless_clauses_have_no_score():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 3.0), {})
    for text in ("Hast du die Zeitung gelesen", "they attack the problem", "you kill time", "the fire will burn, you see"):
        assert g.clauses(text)[0] == [], text
    assert g.clauses("i will kill you")[0] == [1.5] and g.clauses("he said: kill you")[0] == [1.5] and g.clauses("he said kill you")[0][0] < 1.5


def test_every_labelled_row_teaches(spark):
    """Near copies share a vote; texts that have single words in common, however rare, keep one each; no row is lost."""
    r = np.random.default_rng(6)
    body = lambda: " ".join("".join(r.choice(list("abcdefgh"), 7)) for _ in range(60))
    copy = body()
    texts = [copy + f" end{k}" for k in range(10)] + [body() + " sharedword" for _ in range(30)]
    sizes = toxicity.group_sizes(np.vstack([toxicity.sketch(t) for t in texts]))
    assert list(sizes) == [10] * 10 + [1] * 30
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(5, "later text of a repeated id"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)] + [(5, 0), (999, 1), (None, 1), (7, None)], "doc_id long, y int")
    rows = toxicity.training_rows(docs.select("doc_id", F.col("text").alias("body")), labels, 100)
    assert rows.count() == 40
    grammar, kept = toxicity.learn(rows)
    got = kept.collect()
    assert len(got) == 40 and abs(sum(x.weight for x in got if x.y == 0) - (1 + 20)) < 1e-9
    assert toxicity.training_rows(docs.select("doc_id", F.col("text").alias("body")), labels, 12).count() == 12


def test_license_versions_and_families():
    model = licenses.Classifier()
    cases = {
        "Licensed under CC BY 3.0.": ("cc-by", "3"), "Licensed under the BSD 3-Clause License.": ("bsd", ""), "SPDX-License-Identifier: LGPL-2.1": ("lgpl", "2.1"),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3": ("agpl", "3"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": ("isc", ""),
    }
    for text, want in cases.items():
        assert [f[1:3] for f in licenses.findings(text, model)] == [want], text
        assert [f[1:3] for f in licenses.findings("\n# ".join(["#", *re.findall(r"(?:\S+ ?){1,6}", text)]), model)] == [want], text
    assert licenses.findings("word " * 300_000 + "\n" + "license " * 100_000, model) == []


def test_sparse_regression_as_dense():
    model = licenses.Classifier(rounds=30)
    x = np.zeros((len(model.y), model.x.width))
    x[model.x.row, model.x.at] = model.x.values[:, 0]
    hot, weights, pace = np.eye(len(model.families))[model.y], 0.0 * model.weights, 0.0 * model.weights
    for _ in range(30):
        pace = 0.9 * pace + 0.1 * (x.T @ (hot - licenses.softmax(x @ weights)) / len(x) - 1e-4 * weights)
        weights = weights + 10 * pace
    assert np.allclose(weights, model.weights) and (x != 0).mean() < 0.1


def test_license_probabilities_are_calibrated_on_other_texts():
    trained = {t for ts in licenses.TEMPLATES.values() for t in ts} | set(licenses.UNLICENSED)
    held = [(f, t) for f, ts in licenses.HELD_OUT.items() for t in ts]
    assert not trained & {t for _, t in held}
    model = licenses.Classifier()
    assert np.mean([model.predict(t)[0] == f for f, t in held]) > 0.8


@pytest.mark.parametrize(
    "text, want",
    [
        ('He said, "you are an idiot"', 3 * 1.25 * 0.7), ('"You are an idiot," he said', 3 * 1.25 * 0.7), ("He said you are an idiot", 3 * 1.25 * 0.7),
        ("he said, you are an idiot", 3 * 1.25 * 0.7), ("you are an idiot, he said", 3 * 1.25 * 0.7), ("“You are an idiot”, said he.", 3 * 1.25 * 0.7),
        ('She wrote: "Leave. You are an idiot. Go away!"', 3 * 1.25 * 0.7), ('"Go away. You are an idiot," she said. You moron', 3 * 1.25 * 0.7 + 3 * 1.25),
        ('He said hello. "You are an idiot"', 3 * 1.25), ('"You are an idiot" is no title', 3 * 1.25), ('say "you are an idiot\nhe said, moron', 3 * 1.25 + 3 * 0.7),
        ("you aren\u2019t an idiot", 3 * 1.25 * 0.4), ("you aren't an idiot", 3 * 1.25 * 0.4), ("you couldn't be an idiot", 3 * 1.25 * 0.4), ("you're an idiot", 3 * 1.25), ("tu n'es pas l'imb\u00e9cile", 3 * 1.25 * 0.4),
        ("burn your candles", 0), ("kill your darlings", 0), ("the rain will beat your crops", 0), ("i will burn your house", 1.5), ("i will break and kill your little brother", 1.5),
        ("he said he will kill you", 1.5 * 0.7), ("i won't hurt you", 1.5 * 0.4), ("your stupid plan", 3 * 1.25), ("the family house may burn", 0),
    ],
)
def test_scopes_of_reports_negation_and_threats(text, want):
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 3.0), {})
    assert sum(g.clauses(text)[0]) == pytest.approx(want), g.clauses(text)


def test_clauses_of_long_texts_take_time_in_proportion():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 3.0), {})
    began = time.process_time()
    for text in ('"' * 500_000, '" ' * 300_000, "you're an idiot, he said, " * 40_000, "'" * 500_000, ", " + " " * 500_000 + "idiot"):
        g.clauses(text)
    assert time.process_time() - began < 20
