import random

import pytest

from packetlens.llm import licences

PROSE = [
    "The quick brown fox jumps over the lazy dog and runs away.",
    "We went to the market to buy bread and the milk was sold out.",
    "This is a story of a man who lived by the sea with his dog.",
    "Haanth reoush hewh and onon hahehe ing that of ontiontion.",
    "In the year that followed nothing of any note was written down.",
]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, "\n".join(PROSE[i % 5 :] + PROSE[: i % 5])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return licences.fit(docs)


def test_notices_are_found_and_prose_is_not(docs, fitted):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License."),
        (2, "Distributed under the MIT License (see LICENSE)."),
        (3, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-SA 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "Licensed under the Apache License, Version 2.0."),
        (6, "All rights reserved."),
        (7, PROSE[1] + "\n" + PROSE[2]),
        (8, None),
        (9, ""),
        (10, "\n\n!!"),
        (None, "Released under the MIT License."),
        (11, "word " * 50_000),
        (1, "Some prose here.\nReleased under the MIT License."),
    ]
    table = docs(*rows, extra=", family string, words int, id int, features int", values=("f", 1, 2, 3))
    got = {}
    for r in licences.scan(table, fitted).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.confirmed))
        assert 0 <= r.confidence <= 1
    assert sorted(got.pop(1)) == [(1, "mit", True)] * 2
    assert got.pop(None) == [(0, "mit", True)]
    assert got.pop(2)[0][1] in ("mit", "unknown")
    assert sorted(got.pop(3)) == [(0, "cc-by-nc", True), (2, "cc-by-sa", True)]
    assert got.pop(4) == [(0, "gpl", True)] and got.pop(5) == [(0, "apache", True)]
    assert got.pop(6) == [(0, "unknown", False)]
    assert not got


HEADER = """    This {0} is free software{1} you can redistribute it and/or modify
    it under the terms of the GNU {2} as published by
    the Free Software Foundation{3} either version {4} of the License, or
    (at your option) any later version.

    This {0} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {2} for more details.
"""
WRAPPED = {
    "gpl": HEADER.format("program", ":", "General Public License", ",", "3"),
    "lgpl": HEADER.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "agpl": HEADER.format("program", ":", "Affero General Public License", ",", "3"),
    "mit": """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
 * LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
 * OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
 * SOFTWARE.
 */""",
}


def test_wrapped_headers_and_disclaimers(docs, fitted):
    families = list(WRAPPED)
    rows = [(i, PROSE[0] + "\n\n" + WRAPPED[f] + "\n" + PROSE[1]) for i, f in enumerate(families)]
    got = {}
    for r in licences.scan(docs(*rows), fitted).collect():
        got.setdefault(families[r.doc_id], []).append((r.paragraph, r.family, r.confirmed))
    places = {f: (3, 10) if f == "mit" else (2, 7) for f in families}
    assert {f: sorted(g) for f, g in got.items()} == {f: [(p, f, True) for p in places[f]] for f in families}


def brute_paragraphs(text):
    found, open_ = [], False
    for i, line in enumerate((text or "").split("\n")):
        has_word = any(c.isalnum() for c in line)
        if open_ and has_word:
            found[-1][1] += " " + line
        else:
            found.append([i, line])
        signs = [c for c in line if c.isalnum() or c in ".!?:"]
        open_ = has_word and signs[-1] not in ".!?:"
    return [(i, t) for i, t in found if any(c.isalnum() for c in t)]


def test_paragraphs_equal_brute_force(docs):
    rng = random.Random(8)
    parts = ["a", "bc", ".", ":", " ", "\n", "\n", "\n\n", "\r\n", '"', "é", "7", ";", "!)"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [*enumerate(texts), (999, None), (1000, "\n"), (1001, "no end")]
    got = licences._paragraphs(docs(*rows), "doc_id", "text").collect()
    want = [(i, p, t) for i, text in rows for p, t in brute_paragraphs(text)]
    assert sorted((r.id, r.paragraph, r.text) for r in got) == sorted(want)


def test_probabilities_are_shares(spark, docs, fitted):
    assert 0 < fitted.temperature <= 4 and 0.4 <= fitted.least < 1
    assert licences.scan(docs(), fitted).collect() == []


def test_fit_without_documents(docs):
    model = licences.fit(docs())
    (row,) = licences.scan(docs((1, "Released under the MIT License.")), model).collect()
    assert row.family == "mit"
