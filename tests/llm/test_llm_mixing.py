import random

import numpy as np
import pytest

from packetlens.llm import mixing

CELLS = "source string, lang string, n bigint"


def raked(rows, targets, sweeps=400):
    """Iterative proportional fitting on a small table in numpy."""
    w = np.array([r[-1] for r in rows], dtype=float)
    total = w.sum()
    for _ in range(sweeps):
        for m, shares in targets.items():
            column = [r[m] for r in rows]
            present = sum(shares.get(v, 0) for v in {c for c, x in zip(column, rows) if x[-1] > 0})
            sums = {v: w[[c == v for c in column]].sum() for v in set(column)}
            w = w * [shares.get(v, 0) / present * total / sums[v] if sums[v] else 0 for v in column]
    return w


def table(spark, shares):
    return spark.createDataFrame(list(shares.items()), "value string, share double")


def test_raking_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(s, l, rng.randrange(1, 1000)) for s in ("a", "b", None) for l in ("en", "de", "fr", None)]
    rows[3] = (*rows[3][:2], 0)
    targets = {"source": {"a": 0.2, "b": 0.5, None: 0.3, "gone": 0.4}, "lang": {"en": 0.4, "de": 0.3, "fr": 0.2, None: 0.1}}
    cells = spark.createDataFrame(rows, CELLS)
    got = mixing.rake(cells, {m: table(spark, t) for m, t in targets.items()}, "n", "w").collect()
    want = raked(rows, {0: targets["source"], 1: targets["lang"]})
    found = {(r.source, r.lang): r.w for r in got}
    for (s, l, _), w in zip(rows, want):
        assert found[s, l] == pytest.approx(w, rel=1e-3, abs=1e-3)


def test_rates_spend_the_budget(spark):
    rows = [("a", "x", 100, 500.0), ("b", "x", 100, 100.0), ("c", "x", 100, 50.0), ("d", "x", 0, 0.0), ("e", "x", 50, 0.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, n bigint, w double")
    for budget, spent in ((30, 30), (200, 200), (290, 290), (1000, 300)):
        got = mixing.rates(cells, "n", "w", budget, "rate").collect()
        assert sum(r.n * r.rate for r in got) == pytest.approx(spent)
        assert all(0 <= r.rate <= 1 for r in got) and [r.rate for r in got][3:] == [0, 0]
        free = [r.rate / (r.w / r.n) for r in got[:3] if r.rate < 1]
        assert not free or max(free) == pytest.approx(min(free))


def test_sample_meets_the_targets(docs, spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta eta theta".split())
    rows = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(3000)]
    base = docs(*rows)
    table_ = base.selectExpr("doc_id", "text", "if(doc_id % 10 < 8, 'en', 'de') as lang", "if(doc_id % 3 = 0, 'a', null) as source")
    want = {"lang": table(spark, {"en": 0.6, "de": 0.4}), "source": table(spark, {"a": 0.5, None: 0.5})}
    got = mixing.mix_sources(table_, want, share=0.3).collect()
    assert len(got) == 3000
    total = sum(r.n_tokens for r in got)
    drawn = [r for r in got if r.drawn]
    spent = sum(r.n_tokens for r in drawn)
    assert spent == pytest.approx(0.3 * total, rel=0.1)
    assert sum(r.n_tokens for r in drawn if r.lang == "de") / spent == pytest.approx(0.4, abs=0.05)
    assert sum(r.n_tokens for r in drawn if r.source) / spent == pytest.approx(0.5, abs=0.05)
    again = {r.doc_id for r in mixing.mix_sources(table_, want, share=0.3).collect() if r.drawn}
    assert again == {r.doc_id for r in drawn}


def test_edges(docs):
    assert mixing.mix_sources(docs()).collect() == []
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "long " * 50_000)]
    table_ = docs(*rows, extra=", topic string, rate int, n_tokens int, drawn int, _weight int", values=("t", 1, 2, 3, 4))
    out = mixing.mix_sources(table_, share=1.0)
    assert out.columns == [*table_.columns, "_n_tokens", "_topic", "_rate", "_drawn"]
    by = {(r.doc_id, r._drawn) for r in out.collect()}
    assert by == {(1, False), (2, False), (3, True), (None, True)}
    assert mixing.sample(table_, share=1.0).columns == table_.columns
    assert mixing.sample(table_, share=1.0).count() == 3
