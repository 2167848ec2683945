import math
import random
from collections import Counter

import pytest

from groundline.llm import license_texts, licenses
from groundline.llm.queries import QUERIES

MIT, APACHE, NC = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."


def test_nearest_directory(spark):
    files = [
        (0, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + "\n\n".join(license_texts.TEXTS["MIT"])), (1, "a/b/c/x.py", "plain words"), (2, "a/b/COPYING.txt", APACHE), (3, "a/b/c/y.py", f"# {NC}\ncode = 1"),
        (4, "a/z.py", ""), (5, "q/r.py", None), (6, None, "text"), (7, "a/b/c/d/notice", MIT), (8, "a/b/c/d/e/w", "x"), (9, "top", "x"), (9, "top", "x"),
        (10, "a/b/c2/v", "the licensed driver of a copyright office reads about an apache village"), (11, "a/b/COPYING", APACHE), (12, "n/o", f"many words of prose come before. {MIT}"), (13, "n/p", "x"),
    ]
    df = spark.createDataFrame([(*f, "z", 1) for f in files], "doc_id long, path string, text string, dir string, license int")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(files)
    found = {r["doc_id"]: (r["license"], r["origin"], r["license_path"]) for r in rows}
    assert found == {
        0: ("MIT", "file", "a/LICENSE"), 1: ("Apache-2.0", "inherited", "a/b/COPYING"), 2: ("Apache-2.0", "file", "a/b/COPYING.txt"), 3: ("CC-BY-NC-4.0", "notice", "a/b/c/y.py"),
        4: ("MIT", "inherited", "a/LICENSE"), 5: (None, "none", None), 6: (None, "none", None), 7: ("MIT", "file", "a/b/c/d/notice"), 8: ("MIT", "inherited", "a/b/c/d/notice"), 9: (None, "none", None),
        10: ("Apache-2.0", "inherited", "a/b/COPYING"), 11: ("Apache-2.0", "file", "a/b/COPYING"), 12: ("MIT", "notice", "n/o"), 13: (None, "none", None),
    }
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_templates_find_themselves():
    for name, text in licenses.TEMPLATES:
        words = licenses.WORDS.findall(text.lower())
        score, found = licenses.nearest(words)
        same = {n for n, t in licenses.TEMPLATES if licenses.terms(licenses.WORDS.findall(t.lower())) == licenses.terms(words)}
        assert score == pytest.approx(1) and found in same and name in same


def cosine(a, b, idf, rare):
    x, y = ({t: k * idf.get(t, rare) for t, k in licenses.terms(w).items()} for w in (a, b))
    dot = sum(v * y.get(t, 0.0) for t, v in x.items())
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_cosines_against_brute_force():
    """Random cuts and mixtures of notices and prose: every piece by every template, without inverted lists or bounds."""
    rng = random.Random(3)
    prose = "the quick brown fox may use and copy a license to drive under the bridge. Permission was granted by all rights holders! We modify software".split()
    every = [licenses.WORDS.findall(t.lower()) for _, t in licenses.TEMPLATES]
    df = Counter(t for w in every for t in set(licenses.terms(w)))
    idf = {t: math.log((1 + len(every)) / (1 + n)) + 1 for t, n in df.items()}
    for _ in range(60):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        k = rng.randrange(len(words))
        some = rng.choices(prose, k=rng.randint(0, 20)) + words[k:k + rng.randint(2, 60)] + rng.choices(prose, k=rng.randint(0, 12))
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", "\n# "]) for w in some)
        own, ranges = licenses.pieces_of(licenses.TOKEN.findall(text.lower()))
        scores = {(a, b): max(cosine(own[a:b], t, idf, max(idf.values())) for t in every) for a, b in ranges.tolist()}
        for a, b in ranges.tolist():
            assert licenses.nearest(own[a:b])[0] == pytest.approx(scores[a, b])
        assert {tuple(r) for r in licenses.reachable(own, ranges, 0.7).tolist()} >= {r for r, v in scores.items() if v >= 0.7}
        top = max(scores.values(), default=0.0)
        name, score, _ = licenses.notice(text, 0.7)
        assert (score == pytest.approx(top, abs=1e-5)) if top >= 0.7 else name is None


def test_long_texts_and_ties(spark):
    long = "plain words without any grant. " * 60_000
    rows = [(1, None, long + "\n" + MIT), (2, None, long), (3, None, f"{MIT}\n{APACHE}"), (4, None, f"{APACHE}\n{MIT}"), (5, "x/LICENSE", MIT), (6, "x/COPYING", APACHE), (7, "x/y/z", "")]
    found = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert found[1] == ("MIT", "notice") and found[2] == (None, "none")
    assert found[3] == ("Apache-2.0", "notice") and found[4] == ("Apache-2.0", "notice")  # equal cosines: the longer notice
    assert found[7] == ("Apache-2.0", "inherited")  # equal cosines: the smaller path


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op7_licenses"](spark, sf).collect()
    assert all(r["origin"] in ("none", "notice", "file") and r["license_path"] is None for r in rows)  # no paths: nothing is inherited
    found = {r["doc_id"]: r for r in rows}
    lines = {MIT: "MIT", APACHE: "Apache-2.0", NC: "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    for r in docs.collect():
        held = {name for line, name in lines.items() if line in (r["text"] or "")}
        own = found[r["doc_id"]]["license"]
        assert own in held if held else own is None


GNU = "{what} is free software{a} you can redistribute it and/or modify\nit under the terms of the GNU {kind} as published by\nthe Free Software Foundation{b} either version {version} of the License, or\n(at your option) any later version.\n"
BSD = (
    "Copyright (c) 2020, Some Body\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
)
THIRD = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"


@pytest.mark.parametrize(("name", "text"), [
    ("GPL-2.0", GNU.format(what="This program", kind="General Public License", version="2", a=";", b=";")),
    ("GPL-3.0", GNU.format(what="This program", kind="General Public License", version="3", a=":", b=", ")),
    ("LGPL-2.1", GNU.format(what="This library", kind="Lesser General Public License", version="2.1", a=";", b=";")),
    ("LGPL-3.0", GNU.format(what="This program", kind="Lesser General Public License", version="3", a=":", b=",")),
    ("AGPL-3.0", GNU.format(what="This program", kind="Affero General Public License", version="3", a=":", b=",")),
    ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + THIRD),
])
def test_standard_texts(name, text):
    assert licenses.notice(text, 0.7)[0] == name
    assert licenses.notice("".join(f"# {line}\n" for line in text.split("\n")), 0.7)[0] == name
