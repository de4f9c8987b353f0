import random

import numpy as np
import pyarrow as pa
import pytest

from packetlens.llm import quality
from packetlens.llm.words import text_blocks


def make(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        passages = [" ".join(word() for _ in range(128)) for _ in range(rng.randrange(1, 6))]
        bad = i % 3 == 0
        if bad:  # one spoiled passage among good ones
            k = rng.randrange(len(passages))
            passages[k] = " ".join(w.upper() + "!!" for w in passages[k].split())
        rows.append((i, " ".join(passages)))
        labels.append((i, int(not bad)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = make(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))


def test_held_out_accuracy(docs, fitted):
    rows, labels = make(150, seed=2)
    got = {r.doc_id: r.score for r in quality.score(docs(*rows), fitted).collect()}
    right = sum((got[i] >= quality.THRESHOLD) == bool(q) for i, q in labels)
    assert right >= 140


def test_attention_finds_the_spoiled_passage(fitted):
    rows, _ = make(4, seed=3)
    ((_, _, block, offsets),) = text_blocks(pa.array([rows[0][1] + " " + rows[1][1]]), lower=False)
    x, bags = quality.encode(block, offsets)
    assert quality.AttentionModel.forward(fitted, x, bags)["attention"].sum() == pytest.approx(1)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, bags = rng.normal(size=(7, quality.FEATURES)), np.array([0, 1, 4, 7])
    label = np.array([1.0, 0.0, 1.0])
    model = quality.train(x, bags, np.array([1.0, 1.0, 1.0]))
    model.weights["o"] = rng.normal(size=quality.HIDDEN)

    def loss():
        s = model.forward(x, bags)["score"]
        return -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))

    for name, g in model.gradients(x, bags, label).items():
        w = model.weights[name] = np.array(model.weights[name], dtype=float)
        at = tuple(rng.integers(0, n) for n in w.shape)
        before = w[at]
        w[at] = before + 1e-6
        up = loss()
        w[at] = before - 1e-6
        down = loss()
        w[at] = before
        assert np.asarray(g)[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_edges(spark, docs, fitted):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 60_000), (None, "x"), (4, "y"), (5, "漢字" * 5000)]
    table = docs(*rows, extra=", score string, passages int", values=("s", 1))
    got = quality.score(table, fitted).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    kept = quality.keep_good(table, fitted, least=0.0)
    assert kept.columns == table.columns and kept.count() == 7
    assert quality.score(docs(), fitted).collect() == []
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    unlabelled = quality.fit(docs((1, "a")), none)
    assert quality.score(docs((1, "a")), unlabelled).first().score == pytest.approx(0.5)
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id bigint, quality int")
    assert quality.score(docs((3, "a")), quality.fit(docs((3, "a")), odd)).first().score > 0.5


def test_the_sample_is_bounded(spark, docs):
    rows, labels = make(60, seed=5)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    few = quality.fit(docs(*rows), table, sample=4)
    assert few.center.shape == (quality.FEATURES,)
