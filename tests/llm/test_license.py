import random
import re

from pagelight.llm import license


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(3)
    vocab = ["cc", "by", "BY-", "CC", "general", "Public", "license", "all", "rights", "reserved.", "the", "été", "2.0", "x_y"]
    return [None, "", "!!", "All rights reserved", "CC BY-NC 4.0"] + [" ".join(rng.choices(vocab, k=rng.randrange(40))) for _ in range(300)]


def test_base_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "l", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license.scan(df).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_templates(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "this piece is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "All rights reserved.": "reserved",
        "under the license version 3 of the general": "",
        "released under the license mit": "",
    }
    rows = [(i, f"Word word. {t} And on.") for i, t in enumerate(lines)] + [(None, None), (1, "again"), (1, "again")]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.n_words > 1}
    assert [by[i].labels for i in range(len(lines))] == list(lines.values())
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_real_headers():
    lines = {
        "Licensed under the Apache Software License, Version 2.0 (the License)": "apache-2.0",
        "Apache License\n Version 2.0, January 2004": "apache-2.0",
        "The MIT License (MIT)": "mit",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "# SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or": "gpl,gpl-2.0",
        "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or": "gpl,gpl-3.0",
        "the terms of the GNU Lesser General Public License": "gpl,lgpl",
        "the terms of the GNU Affero General Public License": "agpl,gpl",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
        "the licence of the software is to be discussed in version 2 of the plan": "",
        "an apache helicopter was licensed under the old rules, version 2": "",
        "SPDX license identifier list": "",
        "public license general": "",
    }
    index = license.Index({}, 0)
    assert {t: index.scan(license.words_of(t.encode()))["labels"] for t in lines} == lines


def test_index_finds_what_a_scan_of_all_places_finds():
    rng = random.Random(8)
    index = license.Index({w: rng.randrange(900) for w in license.vocabulary()}, 1000)
    for _ in range(400):
        ws = []
        for _ in range(3):
            t = rng.choice(license.TEMPLATES)[1].encode().split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice([[], [b"word"]])
            ws += [b"and"] * rng.randrange(3) + t
        want = set()
        for t, (label, text, keys) in enumerate(license.TEMPLATES, len(license.BASE)):
            p, d = text.encode().split(), license.drift_of(text.encode().split())
            for s in range(-len(p) - d, len(ws) + d):
                got = sum(index.idf[w] for k, w in enumerate(p) if w in ws[max(0, s + k - d) : max(0, s + k + d + 1)])
                held = b" %s " % b" ".join(ws[max(0, s - d) : max(0, s + len(p) + d)])
                if got >= license.SHARE * index.total[t] - 1e-9 and all(b" %s " % k.encode() in held for k in keys):
                    want.add(label)
        found = index.scan(ws)
        assert set(filter(None, found["labels"].split(","))) == want | set(filter(None, found["base_labels"].split(",")))
