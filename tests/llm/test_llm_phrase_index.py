import random
import re

import pytest

from packetlens.llm import phrase_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=10):
    windows = set()
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1):
            if n:
                windows.add((tuple(w[i : i + n]), name))
    result = []
    for identity, text in rows:
        w, hit, found = words(text), set(), set()
        for window, name in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(name)
        result.append((identity, len(w), len(hit), sorted(x for x in found if x is not None)))
    return result


@pytest.fixture
def case():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["ab", "Ünï", "42", "é"]) for _ in range(n))
    vocabulary = [f"t{i}" for i in range(40)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"i{k}", " ".join(some(rng.randrange(1, 30)))) for k in range(12)]
    items += [("short", "t1 T2"), ("none", "--"), ("null", None), (None, "t3 t3 t3"), ("short", "t5 t5 t6")]
    rows = []
    for k in range(40):
        part = items[k % 12][1].split()
        rows.append((k, ", ".join([*some(20), *part[k % 3 :], *some(k)])))
    rows += [(100, None), (101, ""), (102, "!!"), (103, text(50)), (None, items[0][1]), (3, rows[3][1])]
    rows += [(104, "t1 t2 " * 20_000), (105, "t1"), (106, "t2")]
    return rows, items


def check(spark, docs, case):
    rows, items = case
    table = spark.createDataFrame(items, "item_id string, text string")
    got = phrase_index.contamination(docs(*rows), table).collect()
    order = lambda r: (r[0] is not None, r[0], r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=order) == sorted(
        brute(rows, items), key=order
    )


def test_equals_brute_force(spark, docs, case):
    check(spark, docs, case)


def test_item_blocks_and_whole_index(spark, docs, case, monkeypatch):
    monkeypatch.setattr(phrase_index, "ITEM_BYTES", 300)
    monkeypatch.setattr(phrase_index, "MAX_TERMS", 5)
    check(spark, docs, case)


def test_empty_tables_and_other_columns(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert phrase_index.contamination(docs(), none).collect() == []
    (row,) = phrase_index.contamination(docs((1, "a b")), none).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])
    item = spark.createDataFrame([(1, "bad words")], "item_id bigint, text string")
    table = docs((1, "bad words"), (None, "bad words"), (None, "good"), (2, None), extra=", key int, n_hit int", values=(1, 2))
    kept = phrase_index.drop_contaminated(table, item)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, "good")]
    assert kept.count() == 2


def test_proximity(spark, docs):
    rows = [(1, "a x b y c"), (2, "a x x x b c"), (3, "c b a"), (4, "a b"), (5, "c"), (6, None)]
    items = spark.createDataFrame([("q", "a b c b"), ("r", None)], "item_id string, text string")
    index = phrase_index.build_index(docs(*rows), "doc_id", "text")
    found = phrase_index.proximity(index, items, 5).collect()
    assert {r.id for r in found} == {1, 3}
    assert {r.id for r in phrase_index.proximity(index, items, 3).collect()} == {3}
