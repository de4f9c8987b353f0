import random

import pytest
from pyspark.sql import functions as F

from packetlens.llm import token_counts as tc

SPANS = "array<struct<begin:bigint,stop:bigint>>"


def token_spans(text):
    encoder, lengths = tc.encoding(tc.VOCABULARY)
    data, at, out = text.encode(), 0, []
    for t in encoder.encode_ordinary(text):
        out.append((at, at + int(lengths[t])))
        at = out[-1][1]
    assert at == len(data)
    return out


def brute(text, sections, rule):
    starts = [len(text[:i].encode()) for i in range(len(text) + 1)]
    clip = lambda x: starts[min(max(x, 0), len(text))]
    edges = [(0, 0) if s is None or None in s else (clip(s[0]), max(clip(s[1]), clip(s[0]))) for s in sections]
    spans = token_spans(text)
    point = {"start": lambda a, b: a, "middle": lambda a, b: (a + b - 1) // 2, "end": lambda a, b: b - 1}[rule]
    share = lambda lo, hi: sum(max(min(b, hi) - max(a, lo), 0) / (b - a) for a, b in spans)
    rows = [
        (i, sum(lo <= point(a, b) < hi for a, b in spans), round(share(lo, hi), 6))
        for i, (lo, hi) in enumerate(edges)
    ]
    free = [not any(lo <= x < hi for lo, hi in edges) for x in range(len(text.encode()))]
    if any(free):
        left = sum(free[point(a, b)] for a, b in spans)
        part = sum(sum(free[a:b]) / (b - a) for a, b in spans)
        rows.append((-1, left, round(part, 6)))
    return rows


@pytest.mark.parametrize("rule", tc.RULES)
def test_equals_brute_force(spark, rule):
    rng = random.Random(2)
    texts = ["Hello world, this is text.", "naïve façade — 漢字 🙂 done", "a" * 40, "x", "internationalisation\n\nnow"]
    rows = []
    for k in range(40):
        text = texts[k % 5]
        spans = [(rng.randrange(-2, 30), rng.randrange(0, 45)) for _ in range(rng.randrange(4))]
        rows.append((k, text, [*spans, None][: rng.randrange(5)]))
    rows += [(100, "some words", [(0, None), (2, 7)])]
    table = spark.createDataFrame(rows, f"doc_id bigint, text string, spans {SPANS}")
    got = tc.section_tokens(table, sections=F.col("spans"), rule=rule).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.section, r.n_tokens, round(r.share, 6)))
    want = {k: brute(t, s, rule) for k, t, s in rows}
    assert by == {k: v for k, v in want.items() if v}


def test_lines_hold_all_tokens(docs):
    texts = ["one\ntwo lines\n\nthree", "", None, "\n", "no break", "é\n漢字", "long " * 30_000]
    got = tc.section_tokens(docs(*enumerate(texts), extra=", section string, spans int", values=("a", 1))).collect()
    for i, text in enumerate(texts):
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.n_tokens for r in mine) == len(token_spans(text or ""))
        lines = (text or "").splitlines(keepends=True) or [""]
        assert [(text or "")[r.begin : r.stop] for r in mine] == lines


def test_empty_table_null_ids_and_rule(docs):
    assert tc.section_tokens(docs()).collect() == []
    assert [r.n_tokens for r in tc.section_tokens(docs((None, "a"), (None, "a"))).collect()] == [1, 1]
    with pytest.raises(ValueError):
        tc.section_tokens(docs(), rule="other")
