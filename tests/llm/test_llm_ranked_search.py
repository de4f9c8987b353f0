import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from packetlens.llm import ranked_search

ITEMS = "item_id bigint, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, items, top=10):
    """The definition, text by text."""
    terms = [Counter(words(t)) for _, t in rows]
    n = [sum(c.values()) for c in terms]
    count, total = sum(map(bool, n)), sum(n)
    held = Counter(t for c in terms for t in c)
    best = []
    for item, text in items:
        scores = []
        for (doc, _), c, size in zip(rows, terms, n):
            score = 0
            for term in set(words(text)) & set(c):
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * held[term] + 1)))
                m = 100 - 90 + (90 * size * count) // total
                score += w * ((1000000000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:top], 1):
            best.append((item, rank, None if null else doc, -score))
    return sorted(best, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def some_rows(count, seed):
    random.seed(seed)
    letters = [f"w{i}" for i in range(60)] + ["Été", "漢字", "ZZ", "a1"]
    text = lambda most: " ".join(random.choices(letters, k=random.randrange(most)))
    return [(i, text(80)) for i in range(count)], [(i, text(12)) for i in range(15)]


@pytest.mark.parametrize("block_bytes", [ranked_search.BLOCK_BYTES, 300])
def test_like_brute_force(spark, docs, block_bytes):
    rows, items = some_rows(300, 1)
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    got = ranked_search.search(docs(*rows), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    assert found(got) == brute(rows, items)


def test_small_runs_of_cells_give_the_same(spark, docs, monkeypatch):
    rows, items = some_rows(120, 2)
    monkeypatch.setattr(ranked_search, "CELLS", 40)
    monkeypatch.setattr(ranked_search, "FAN_IN", 2)
    got = ranked_search.search(docs(*rows), spark.createDataFrame(items, ITEMS), top=3)
    assert found(got) == brute(rows, items, 3)


def test_nulls_repeats_and_clashing_names(spark, docs):
    rows = [(3, "red fox"), (3, "red fox"), (None, "red fox"), (1, None), (2, ""), (4, "blue " * 30_000)]
    items = [(1, "RED Fox!"), (1, "red"), (None, "blue"), (5, None), (6, "... !"), (7, "unseen")]
    names = ", rank int, score string, item_id int, number int"
    many = docs(*rows, extra=names, values=(1, "x", 2, 3))
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS + ", doc_id int")
    assert found(ranked_search.search(many, asked)) == brute(rows, items)


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert found(ranked_search.search(docs(), items)) == []
    assert found(ranked_search.search(docs((1, None)), items)) == []
    assert found(ranked_search.search(docs((1, "a")), items.limit(0))) == []


def test_string_ids_rank_by_their_order(spark):
    docs = spark.createDataFrame([(k, "cat") for k in ("b", "a", "c")] + [("d", "dog")], "k string, t string")
    items = spark.createDataFrame([("i", "cat")], "q string, x string")
    got = ranked_search.search(docs, items, 2, "k", "t", "q", "x").orderBy("rank")
    assert [r.k for r in got.collect()] == ["a", "b"]


def test_sums_beyond_the_precision_of_doubles():
    index = ranked_search.Index(np.arange(3, dtype=np.uint64), np.array([0, 1, 2, 3]), np.zeros(3, dtype=np.int64), np.array([0]))
    weights = np.array([2**40 + 1, 2**40 + 3, 2**40 + 5])
    one = np.ones(3, dtype=np.int64)
    counts = (np.array([3]), np.zeros(3, dtype=np.int64), np.arange(3), 1000 * one)
    (_, scores), = ranked_search.score_rows(index, weights, 10, 10**9, *counts)
    each = (1000000000 * 1000) // (1000 * 1000 + 8 * 10)
    assert scores.tolist() == [[sum(int(w) * each for w in weights)]]


def test_heap_keeps_ties_of_least_id():
    heaps = ranked_search._Heaps(1, 2)
    for ids in ([9, 8], [7, None], [1, 2]):
        heaps.add(np.full((2, 1), 5), pa.array(ids, pa.int64()))
    assert heaps.kept.column("id").to_pylist() == [1, 2]
