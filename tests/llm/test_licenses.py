"""Licence scans: wordings not used in training, the query against windows tried one by one, long texts."""

import time

import pytest

from sparkloft.llm import licenses

SMALL = "/root/testdata/sf0.01"
#: Wordings by family; None: no licence, or none of the families.
WORDINGS = {
    "apache": [
        "Distributed under the terms of the Apache License, Version 2.0",
        "Code licensed under Apache 2.0",
        "The project uses the Apache License 2.0",
        "see LICENSE (Apache-2.0 License)",
    ],
    "mit": [
        "This software is provided under the MIT License",
        "The library is MIT licensed",
        "license = MIT",
        "It is available under the MIT license, see below",
        "* MIT License *",
        "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation",
    ],
    "gpl": [
        "The plugin is released under the GNU GPL v3",
        "GNU GPL version 3 or any later version",
        "This code is licensed under GPLv2",
        "License: GPLv3+",
        "GPL-2.0-only",
        "GNU General Public License as published by the Free Software Foundation; either version 2",
        "Published under the GNU General Public License",
    ],
    "agpl": [
        "The server is released under the GNU Affero General Public License",
        "Licensed under AGPLv3",
        "AGPL-3.0-only",
    ],
    "lgpl": [
        "Linking is allowed by the GNU Lesser General Public License",
        "Licensed under LGPLv3",
        "LGPL-2.1-or-later",
    ],
    "cc-by": [
        "Images: CC BY 4.0",
        "Content is licensed under a Creative Commons Attribution 4.0 International License",
        "The text is under CC BY 3.0",
    ],
    "cc-by-nc": [
        "Figures: CC BY-NC 4.0",
        "Content is licensed under Creative Commons Attribution-NonCommercial 4.0",
    ],
    "cc-by-sa": [
        "Maps: CC BY-SA 4.0",
        "Content is licensed under a Creative Commons Attribution-ShareAlike 4.0 License",
    ],
    "cc-by-nd": [
        "Videos: CC BY-ND 4.0",
        "Content is licensed under a Creative Commons Attribution-NoDerivatives 4.0 License",
    ],
    "cc-by-nc-sa": [
        "Slides: CC BY-NC-SA 4.0",
    ],
    "cc-by-nc-nd": [
        "Slides: CC BY-NC-ND 4.0",
    ],
    "cc0": [
        "Dedicated to all under CC0 1.0 Universal",
        "This dataset is licensed under CC0",
    ],
    "bsd": [
        "BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license",
        "Released under the 3-Clause BSD License",
        "Redistribution and use in source and binary forms are permitted provided that the following conditions are met",
        "The New BSD License",
    ],
    "isc": [
        "The package is under the ISC License",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    ],
    "mpl": [
        "Files are subject to the terms of the Mozilla Public License, v. 2.0",
        "MPL-2.0",
        "The module is covered by the Mozilla Public License",
    ],
    "epl": [
        "Made available under the Eclipse Public License 2.0",
        "EPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software, released into the public domain",
        "The code carries the Unlicense",
    ],
    "boost": [
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0",
    ],
    "zlib": [
        "Licensed under the zlib license",
        "The zlib License",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of these files is strictly prohibited",
    ],
    None: [
        "European Union Public Licence 1.2",
        "Licensed under the European Union Public Licence",
        "terms of the Microsoft Public License",
        "Released under the Affero-like Foo License",
        "Licensed under the Netscape Public License, version 1.1",
        "SPDX-License-Identifier: MulanPSL-2.0",
        "This work is licensed under the Elastic License 2.0",
        "Licensed under the IBM Public License",
        "licensed under the Server Side Public License",
        "MIT is in Cambridge",
        "Apache Spark is a fast engine",
        "The general public licence fee rose",
        "His driving license was renewed under the new terms",
        "The mozilla browser is free",
        "All rights were reserved by the king",
        "A creative person without common sense",
        "The eclipse was public",
        "GPL is short for a long name",
        "not licensed under the MIT License",
        "The zlib library compresses",
        "permission was granted to any person",
    ],
}


@pytest.fixture(scope="module")
def model():
    return licenses.Classifier()


def test_other_wordings(model):
    used = {t for d in (licenses.TEMPLATES, licenses.HELD_OUT) for ts in d.values() for t in ts} | set(licenses.UNLICENSED)
    assert sum(map(len, WORDINGS.values())) >= 75 and not used & {w for ws in WORDINGS.values() for w in ws}
    wrong = [(w, family, found) for family, ws in WORDINGS.items() for w in ws if (found := [f[1] for f in licenses.findings(w, model)]) != ([family] if family else [])]
    assert not wrong


def test_every_family_is_calibrated_and_named():
    assert set(licenses.HELD_OUT) == {*licenses.TEMPLATES, licenses.UNKNOWN} and set(licenses.NAMES) == set(licenses.TEMPLATES)
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            assert family in licenses.named(licenses.words_of(t)), t


def test_longest_name_counts():
    named = lambda t: licenses.named(licenses.words_of(t))
    assert named("CC BY-NC-SA 4.0 and CC BY 4.0") == {"cc-by-nc-sa", "cc-by"} and named("cc-by-nc") == {"cc-by-nc"}
    assert named("GNU Lesser General Public License") == {"lgpl"} and named("GNU General") == set() and named("LGPLv3 or AGPLv3") == {"lgpl", "agpl"}


class Tried(licenses.Classifier):
    """Windows tried one by one, each looked through whole."""

    def candidates(self, words):
        out = []
        for (f, pairs), least, lengths in zip(self.pairs, self.needed, self.lengths):
            for k, length in ((k, n) for k in range(len(words) - 1) if (words[k], words[k + 1]) in pairs for n in lengths):
                at = [x for x in range(k, min(len(words) - 1, k + length - 1)) if (words[x], words[x + 1]) in pairs]
                kinds = {(words[x], words[x + 1]) for x in at}
                if len(kinds) >= least:
                    out.append((len(kinds), len(kinds) / len(pairs), k - at[-1] - 2, -k, f))
        return sorted(out, reverse=True)


def test_query_as_windows_tried_one_by_one(spark):
    slow, want = Tried(), {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        found = licenses.findings(r.text or "", slow)
        listed = lambda xs: ",".join(sorted(set(xs)))
        want[r.doc_id] = (listed(f[1] for f in found), listed(f"{f[1]}-{f[2]}" if f[2] else f[1] for f in found), len(found))
    got = {r.doc_id: (r.families, r.licenses, r.n_paragraphs) for r in licenses.op8_license_scan(spark, SMALL).collect()}
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {} and len(got) == len(want) and sum(bool(w[0]) for w in want.values()) > 5


def test_long_texts_take_time_in_proportion(model):
    notice = licenses.TEMPLATES["apache"][0] + " "
    took = []
    for n in (1_000, 8_000):
        text = notice * n
        began = time.process_time()
        assert len(licenses.findings(text, model)) == n
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] and len(text) > 1_000_000
    assert licenses.findings("licensed under the " * 60_000, model) == []
    assert len(licenses.findings(notice.replace(" ", "\n") * 500, model)) == 500
