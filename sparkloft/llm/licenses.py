"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines between blank ones; marks of comments are no words. A sparse logistic regression over word n-grams
(1 to 3 words) gives a line of it, and each stretch of its words about as long as a notice, a licence family or `unknown`.
It is trained here, on variants of the public notices below and on unlicensed sentences; the unknown class is one of its
classes, also trained on licences that are none of the families, and its probabilities are calibrated by one temperature on other
wordings, of every family, which it was not trained on. A prediction counts only if the words also share enough of a template's
word pairs (all of a template of up to four words) and hold a name of that family, as it is called in NAMES; the longest name at a
place counts. The lines of a paragraph are joined, so notices wrapped over lines, or within long lines, are found too. A notice
that is denied ("not released under ...") is none. The version is the number that the notice itself names.

Features are n-grams of the notices that hold at least one of their less common words. A paragraph without the first word of any
name is unknown by definition, so most paragraphs are settled by one look at their words. Stretches are found by one window that
moves over the places of a template's pairs, so a long text takes time in proportion to its length.

Defined results: null text counts as empty, with no finding. Repeated rows each get findings; a null id is an id like others, in
`op8_license_scan` repeated ids are one document with the findings of all its texts. Of notices that overlap the one that
shares most pairs with its template counts, then the one with the larger share of it, then the shorter, then the first. Very long texts are read whole, a paragraph at a
time. Empty tables give empty results. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.llm.batches import filled
from sparkloft.sources.tables import durable, table

#: Public notices by family, that the classifier is trained on and findings are compared with.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0", "Apache License, Version 2.0", "License: Apache 2.0", "Licensed under Apache 2.0", "Apache 2.0 License",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "MIT License", "License: MIT", "Licensed under MIT", "MIT licensed",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License", "GNU GPL v3", "GNU GPL version 3", "Licensed under GPL v2", "Licensed under the GPL", "GPL 2.0 only", "GPL 3.0 or later", "License: GPL",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Affero General Public License", "GNU AGPL v3", "Licensed under AGPL v3", "AGPL 3.0 only", "AGPL 3.0 or later", "License: AGPL",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1",
        "Lesser General Public License", "GNU LGPL v2.1", "Licensed under LGPL v3", "LGPL 2.1 only", "LGPL 2.1 or later", "License: LGPL",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "CC BY NC 4.0", "Creative Commons Attribution NonCommercial 4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC BY SA 4.0", "Creative Commons Attribution ShareAlike 4.0",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "CC BY ND 4.0", "Creative Commons Attribution NoDerivatives 4.0",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "CC BY NC SA 4.0", "Creative Commons Attribution NonCommercial ShareAlike 4.0",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "CC BY NC ND 4.0", "Creative Commons Attribution NonCommercial NoDerivatives 4.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC BY 4.0", "Creative Commons Attribution 4.0"],
    "cc0": ["This work is released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal", "CC0 1.0", "Licensed under CC0", "License: CC0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD License", "BSD 2 Clause", "BSD 3 Clause", "License: BSD", "BSD style license",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "ISC License", "License: ISC",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License", "MPL 2.0", "Licensed under MPL",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0",
        "Eclipse Public License", "EPL 2.0", "Licensed under EPL",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
        "The Unlicense", "License: Unlicense", "Licensed under the Unlicense",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Boost Software License"],
    "zlib": ["This software is licensed under the zlib License.", "SPDX-License-Identifier: Zlib", "zlib License", "License: zlib"],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "All rights reserved. Unauthorized copying is prohibited."],
}
#: What a notice of a family is called, or says alone; one must stand in it.
NAMES = {
    "apache": ["apache"], "mit": ["mit", "any person obtaining a copy"], "gpl": ["gpl", "gnu general public"], "agpl": ["agpl", "affero general public"],
    "lgpl": ["lgpl", "lesser general public", "library general public"], "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs"],
    "cc0": ["cc0"], "bsd": ["bsd", "redistribution and use in source and binary forms"], "isc": ["isc", "with or without fee is hereby granted"],
    "mpl": ["mpl", "mozilla public"], "epl": ["epl", "eclipse public"], "unlicense": ["unlicense", "unencumbered software released into the public domain"],
    "boost": ["boost software", "bsl"], "zlib": ["zlib"], "proprietary": ["all rights reserved"],
}
#: Licences of no family here, for the unknown class.
OTHERS = "Zope Public|Artistic|Academic Free|Open Software|Python Software Foundation|PHP|Common Development and Distribution|Sleepycat|Open Font|Q Public|Sun Public|Fair|W3C Software|Vim|Ruby".split("|")
OTHER_FORMS = "Licensed under the {} License.|{} License|This program is free software under the terms of the {} License, version 2.0.|Released under the {} Public Licence.|SPDX-License-Identifier: {}".split("|")
#: Lines that speak of like things without granting a licence.
UNLICENSED = (
    "He lost his driving license last year.|The software is fast and free of errors.|Under the bridge the work was done.|"
    "Use the file in the folder.|The general public was not admitted.|Creative people work in common rooms.|"
    "A copy of the letter was made.|The apache helicopter landed.|Version 2.0 of the plan was released.|"
    "Permission to enter was not given.|The foundation was laid in spring.|The source of the river is in the hills.|"
    "The terms of the treaty were published.|Students of MIT won the prize.|A public library opened.|The license plate was bent.|"
    "The moon hid the sun in the eclipse.|All rights of way are reserved for walkers.|The program of the evening was free."
).split("|")
#: Other wordings, for calibration alone.
HELD_OUT = {
    "apache": ["This file is licensed under the Apache License 2.0"], "mit": ["Distributed under the MIT License", "The code is licensed under the MIT license"],
    "gpl": ["This file is released under the GNU General Public License v3"], "lgpl": ["Licensed under the GNU Lesser General Public License version 2.1"],
    "agpl": ["Released under the GNU Affero General Public License v3"], "cc-by": ["Available under a Creative Commons Attribution 4.0 license"],
    "cc-by-nc": ["Available under a Creative Commons Attribution-NonCommercial 4.0 license"], "cc-by-sa": ["Text is available under Creative Commons Attribution-ShareAlike 4.0"],
    "cc-by-nd": ["Photos are under CC BY-ND 4.0"], "cc-by-nc-sa": ["Shared under CC BY-NC-SA 4.0"], "cc-by-nc-nd": ["Shared under CC BY-NC-ND 4.0"], "cc0": ["Data are released under CC0 1.0"],
    "bsd": ["Released under the BSD license"], "mpl": ["Distributed under the Mozilla Public License 2.0"], "isc": ["Released under the ISC license"],
    "epl": ["Released under the Eclipse Public License 2.0"], "unlicense": ["Released under the Unlicense"], "boost": ["Released under the Boost Software License 1.0"],
    "zlib": ["Released under the zlib license"], "proprietary": ["Copyright of the company. All rights reserved. Unauthorized copying of it is prohibited."],
    "unknown": [
        "The public may enter under these terms", "A free copy of the work in any form", "The general gave his permission", "The source of the file is a library",
        "This version is the work of students", "Under the terms of the contract the program ended", "The commons were open to any person", "They published the notice in a public place",
        "Licensed under the Aladdin Free Public License", "Released under the LaTeX Project Public License", "Distributed under the Intel Open Source License",
    ],
}
#: Words that deny, and verbs that grant.
DENIALS, GRANTS = frozenset("not never no longer isn aren wasn nor".split()), frozenset("licensed released distributed available published covered granted".split())
COMMON = frozenset("a an the and or of to in on for by is are be it this that with without not as at from any you may under".split())
UNKNOWN = "unknown"
#: Of a template's word pairs a notice must share so many; of a template of up to SHORT pairs all.
LEAST_PROBABILITY, LEAST_OVERLAP, SHORT = 0.5, 0.5, 3
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


_WITH_VERSION = re.compile(r"(a?gpl|lgpl|mpl|epl|apache|bsd)v?(\d+(?:\.\d+)*)")


def words_of(paragraph: str) -> list[str]:
    """Words in lower case; GPLv2 is two."""
    out = []
    for w in _WORD.findall(paragraph.lower()):
        cut = _WITH_VERSION.fullmatch(w)
        out += [cut[1], "v" + cut[2]] if cut else [w]
    return out


def _name_trie() -> dict:
    root: dict = {}
    for family, names in NAMES.items():
        for name in names:
            at = root
            for w in name.split():
                at = at.setdefault(w, {})
            at[""] = family
    return root


_TRIE = _name_trie()


def named(words: list[str]) -> set[str]:
    """Families whose name stands in the words; of names at one place the longest."""
    found = set()
    for k, w in enumerate(words):
        at, family, n = _TRIE.get(w), None, k
        while at is not None:
            family, n = at.get("", family), n + 1
            at = at.get(words[n]) if n < len(words) else None
        if family:
            found.add(family)
    return found


def ngrams(words: list[str], known: frozenset[str]) -> list[str]:
    """Runs of 1 to 3 words that hold a known word."""
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if not known.isdisjoint(words[i : i + n])]


class Rows:
    """Sparse rows: the columns and values of row r are those from starts[r] on. No row is empty."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        sizes = [len(at) for at, _ in rows]
        self.starts, self.row = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(rows)), sizes)
        self.at, self.values, self.width = np.concatenate([at for at, _ in rows]), np.concatenate([v for _, v in rows])[:, None], width
        self.order = np.argsort(self.at, kind="stable")
        self.columns, self.firsts = np.unique(self.at[self.order], return_index=True)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * weights[self.at], self.starts)

    def transposed_times(self, other: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, other.shape[1]))
        out[self.columns] = np.add.reduceat((self.values * other[self.row])[self.order], self.firsts)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_sparse(x: Rows, y: np.ndarray, classes: int, rounds: int, step: float = 5.0, penalty: float = 1e-4, drag: float = 0.9) -> np.ndarray:
    """Weights of a multinomial logistic regression, by gradient steps with momentum."""
    weights, pace, hot = np.zeros((x.width, classes)), np.zeros((x.width, classes)), np.eye(classes)[y]
    for _ in range(rounds):
        pace = drag * pace + (1 - drag) * (x.transposed_times(hot - softmax(x.times(weights))) / len(y) - penalty * weights)
        weights = weights + 2 * step * pace
    return weights


class Classifier:
    def __init__(self, seed: int = 5, variants: int = 12, rounds: int = 200):
        notices = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
        self.known = frozenset(w for _, t in notices for w in words_of(t)) - COMMON
        self.families = [*TEMPLATES, UNKNOWN]
        self.pairs = [(f, frozenset(_pairs(words_of(t)))) for f, t in notices]
        self.needed = [len(p) if len(p) <= SHORT else LEAST_OVERLAP * len(p) for _, p in self.pairs]
        self.lengths = [{n := len(words_of(t)), n if len(p) <= SHORT else n * 5 // 4} for (_, t), (_, p) in zip(notices, self.pairs)]
        self.index = {g: k for k, g in enumerate(sorted({g for _, t in notices for g in ngrams(words_of(t), self.known)}))}
        rng = np.random.default_rng(seed)
        fillers = [w for t in UNLICENSED for w in words_of(t)]
        rows = [(f, self._vary(words_of(t), fillers, rng, v)) for f, t in notices + [(UNKNOWN, t) for t in UNLICENSED] for v in range(variants)]
        rows += [(UNKNOWN, self._vary(words_of(form.format(name)), fillers, rng, v)) for name in OTHERS for form in OTHER_FORMS for v in range(max(variants // 6, 1))]
        rows += [(UNKNOWN, [str(x) for x in rng.choice(sorted(self.known), 1)]) for _ in range(8 * variants)]
        self.x, self.y = Rows([self._row(w) for _, w in rows], len(self.index) + 1), np.array([self.families.index(f) for f, _ in rows])
        self.weights = fit_sparse(self.x, self.y, len(self.families), rounds)
        held = [(self.families.index(f), self._row(words_of(t))) for f, ts in HELD_OUT.items() for t in ts]
        logits, truth = Rows([r for _, r in held], self.x.width).times(self.weights), np.array([k for k, _ in held])
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in np.linspace(0.3, 3, 28)}
        self.temperature = float(min(loss, key=loss.get))

    @staticmethod
    def _vary(words: list[str], fillers: list[str], rng, variant: int) -> list[str]:
        if not variant:
            return words
        out = [w for w in words if rng.random() > 0.06] or words
        return [*rng.choice(fillers, rng.integers(0, 6)), *out, *rng.choice(fillers, rng.integers(0, 6))]

    def _row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values: the constant, and the n-grams known, as a vector of length one."""
        at = sorted({self.index[g] + 1 for g in ngrams(words, self.known) if g in self.index})
        return np.array([0, *at]), np.array([1.0, *[max(len(at), 1) ** -0.5] * len(at)])

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """Family, its probability, and the overlap with the best template of that family."""
        return self.predict_words(words_of(paragraph))

    def predict_words(self, words: list[str]) -> tuple[str, float, float]:
        """The overlap is 0 if no template of the family has enough of its pairs, or the family's name is not there."""
        if _TRIE.keys().isdisjoint(words):
            return UNKNOWN, 1.0, 0.0
        at, values = self._row(words)
        p = softmax(values @ self.weights[at] / self.temperature)
        family = self.families[int(p.argmax())]
        overlap = 0.0
        if family in named(words):
            seen = _pairs(words)
            overlap = max((n / len(pairs) for (f, pairs), least in zip(self.pairs, self.needed) if f == family and (n := len(pairs & seen)) >= least), default=0.0)
        return family, float(p.max()), overlap

    def candidates(self, words: list[str]) -> list[tuple[int, float, int, int, str]]:
        """Shared pairs, their share of the template, length and begin (both negative) and family of each template whose pairs are near enough
        together, for each place of one of them that a window can begin at. Windows are as long as the template, and a quarter longer."""
        seen, tried = _pairs(words), []
        places: dict[tuple[str, str], list[int]] = {}
        for k, pair in enumerate(zip(words, words[1:])):
            places.setdefault(pair, []).append(k)
        for (f, pairs), least, lengths in zip(self.pairs, self.needed, self.lengths):
            if len(pairs & seen) < least:
                continue
            at = sorted(k for pair in pairs for k in places.get(pair, ()))
            for length in lengths:
                inside: Counter = Counter()
                stop = 0
                for begin in at:
                    while stop < len(at) and at[stop] <= begin + length - 2:
                        inside[words[at[stop]], words[at[stop] + 1]] += 1
                        stop += 1
                    if len(inside) >= least:
                        end = at[stop - 1] + 2
                        tried.append((len(inside), len(inside) / len(pairs), begin - end, -begin, f))
                    gone = words[begin], words[begin + 1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
        return sorted(tried, reverse=True)

    def stretches(self, words: list[str]) -> list[tuple[int, int, str, float, float]]:
        """Stretches of the words (begin, end) with a confirmed licence, family, probability and overlap; they do not meet."""
        if _TRIE.keys().isdisjoint(words):
            return []
        found: list[tuple[int, int, str, float, float]] = []  # in order of places
        judged: dict[tuple[str, ...], tuple[str, float, float]] = {}
        for _, _, size, begin, f in self.candidates(words):
            begin, end = -begin, -begin - size
            k = bisect(found, (begin,))
            if (k and found[k - 1][1] > begin) or (k < len(found) and found[k][0] < end):
                continue
            part = tuple(words[begin:end])
            if part not in judged:
                judged[part] = self.predict_words(list(part))
            family, p, overlap = judged[part]
            if family == f and p >= LEAST_PROBABILITY and overlap >= LEAST_OVERLAP:
                found.insert(k, (begin, end, family, p, overlap))
        return found


def denied(words: list[str], begin: int, end: int) -> bool:
    """Whether a word that grants, between begin and end, has a denial among the three words before it."""
    return any(words[k] in GRANTS and not DENIALS.isdisjoint(words[max(0, k - 3) : k]) for k in range(begin, end))


def version_of(words: list[str]) -> str:
    """The first number of at most two digits before the point that is not of clauses; empty if there is none."""
    for w, after in zip(words, [*words[1:], ""]):
        if re.fullmatch(r"v?\d{1,2}(\.\d+)?", w) and after != "clause":
            return w.removeprefix("v").removesuffix(".0")
    return ""


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:])) or {(w, "") for w in words}


def findings(body: str, model: Classifier) -> list[tuple[int, str, str, float, float, str]]:
    """Number of the first line, family, version, probability, overlap and text (its lines) of each notice with a confirmed licence."""
    out, run = [], []

    def paragraph() -> None:
        words = [(k, w) for k, line in run for w in words_of(line)]
        plain = [w for _, w in words]
        for begin, end, family, p, overlap in model.stretches(plain):
            if not denied(plain, begin, end):
                first, last = words[begin][0], words[end - 1][0]
                lines = (line for _, line in run[first - run[0][0] : last - run[0][0] + 1])
                out.append((first, family, version_of(plain[begin : end + 3]), p, overlap, "\n".join(lines)))
        run.clear()

    for k, line in enumerate(body.split("\n")):
        if line.strip(" \t\r#*/;%-"):
            run.append((k, line))
        else:
            paragraph()
    paragraph()
    return out


FOUND = "paragraph int, family string, version string, probability double, overlap double, line string"


def scan_licenses(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice with a confirmed licence: doc_id, paragraph (number of its first line), family, version (empty if none
    is named), probability, overlap, line (several, if the notice is wrapped). Documents without one have no row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            out = []
            for key, body in zip(b["doc_id"], b["body"]):
                out += [(key, *found) for found in findings(body, model)]
            yield pd.DataFrame(out, columns=["doc_id", *(c.split()[0] for c in FOUND.split(", "))])

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, families (sorted, comma-joined; empty if none), licenses (with versions), n_paragraphs with a licence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, Classifier())
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  as many as there are families and versions
    name = F.concat_ws("-", "family", F.nullif("version", F.lit("")))
    summed = found.groupBy(F.col("doc_id").alias("id")).agg(listed("family").alias("families"), listed(name).alias("licenses"), F.count("*").alias("n_paragraphs"))
    every = docs.select("doc_id").join(durable(summed), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return every.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("licenses", F.lit("")).alias("licenses"),
                        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"))
