import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.llm import language_model as lm
from packetlens.llm.words import mix, unmix

TEXTS = [
    "the cat sat on the mat",
    "The cat  ate the\tfish",
    "a dog sat on the cat",
    "the dog ate",
    "é ü the é",
    "",
    None,
    "the cat sat on the mat",
    "x " * 4000,
]


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.split(), "</s>"]


def discounts(n):
    return lm._discounts([n.get(k, 0) for k in (1, 2, 3, 4)])


class Brute:
    def __init__(self, texts):
        self.bigrams, self.unigrams = Counter(), Counter()
        for text in texts:
            t = tokens(text)
            self.unigrams.update(t)
            self.bigrams.update(zip(["<s>", *t], t))
        self.n, self.v = sum(self.unigrams.values()), len(self.unigrams)
        self.d = discounts(Counter(self.bigrams.values()))
        self.follows = Counter(w for _, w in self.bigrams)
        self.lower = discounts(Counter(self.follows.values()))
        self.context, self.kinds = Counter(), defaultdict(Counter)
        for (v, _), c in self.bigrams.items():
            self.context[v] += c
            self.kinds[v][min(c, 3)] += 1
        self.total = len(self.bigrams)

    def unigram(self, w):
        if not self.total:
            return 1 / (self.v + 1)
        cut = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)
        kinds = Counter(min(c, 3) for c in self.follows.values())
        free = sum(self.lower[k - 1] * kinds[k] for k in (1, 2, 3))
        return cut(self.follows[w], self.lower) / self.total + free / self.total / (self.v + 1)

    def bigram(self, v, w):
        if not self.context[v]:
            return self.unigram(w)
        c = self.bigrams[v, w]
        own = max(c - (0, *self.d)[min(c, 3)], 0) / self.context[v]
        rest = sum(self.d[k - 1] * self.kinds[v][k] for k in (1, 2, 3)) / self.context[v]
        return own + rest * self.unigram(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.bigram(v, w)) for v, w in zip(["<s>", *t], t))

    def base(self, text):
        total = self.n + self.v + 1
        return sum(math.log10((self.unigrams[w] + 1) / total) for w in tokens(text))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm, "SHARD_BYTES", 10)
        monkeypatch.setattr(lm, "BUFFER_KEYS", 3)
        monkeypatch.setattr(lm, "PART_IDS", 4)
    train, brute = TEXTS, Brute(TEXTS)
    model = lm.fit(docs(*enumerate(train)))
    new = ["unseen cat words", "the the", "mat on"]
    rows = [*enumerate(TEXTS), *enumerate(new, 100), (None, "the cat")]
    got = lm.score(docs(*rows, extra=", score string", values=("q",)), model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id]
        assert r.n_tokens == len(tokens(text)) and r.train_tokens == brute.n
        assert r.n_known == sum(w in brute.unigrams for w in tokens(text))
        assert r.score == pytest.approx(brute.score(text), rel=1e-9)
        assert r.base_score == pytest.approx(brute.base(text), rel=1e-9)


def test_probabilities_sum_to_one(docs):
    model = lm.fit(docs(*enumerate(TEXTS)))
    v = len(model.vocabulary)
    for context in [-1, *range(v + 1)]:
        token = np.arange(-1, v)
        assert model.probability(np.full(v + 1, context), token).sum() == pytest.approx(1)


def test_no_training_text(docs):
    model = lm.fit(docs())
    (row,) = lm.score(docs((1, "a b")), model).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == 0 and row.score == 0
    assert lm.score(docs(), model).collect() == []


def test_mix_is_a_bijection():
    x = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (unmix(mix(x)) == x).all()


def test_keeps_columns(docs):
    held = F.col("doc_id") > 1
    model = lm.fit(docs((1, "a")))
    assert lm.score(docs((2, "a")), model, keep={"held_out": held}).first().held_out is True


@pytest.mark.parametrize("most,what", [(3, "words"), (20, "times")])
def test_what_the_arrays_can_not_hold_is_an_error(docs, monkeypatch, most, what):
    monkeypatch.setattr(lm, "MOST", most)
    rows = [(1, "a b c d")] if what == "words" else [(1, "x " * 50)]
    with pytest.raises(Exception, match=what):
        lm.fit(docs(*rows))
