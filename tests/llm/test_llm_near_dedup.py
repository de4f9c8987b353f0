import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from packetlens.llm import near_dedup
from packetlens.llm.components import components


def shingle_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None:
            continue
        common = len(sets[i] & sets[j])
        union = len(sets[i]) + len(sets[j]) - common
        if rows[i][0] == rows[j][0] or common and 100 * common >= 75 * union:
            root[find(i)] = find(j)
    least = {}
    for i, (identity, _) in enumerate(rows):
        if identity is not None:
            least[find(i)] = min(least.get(find(i), identity), identity)
    result = []
    for i, (identity, _) in enumerate(rows):
        component = None if identity is None else least[find(i)]
        result.append((identity, len(sets[i]), component, component is None or component == identity))
    return result


def key(row):
    return tuple((x is not None, x) for x in row)


def families(seed, groups, copies, changes, length=120):
    rng = random.Random(seed)
    rows, identity = [], 1000
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(changes)):
                words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append((identity, " ".join(words)))
            identity -= 1
    return rows


def test_equals_brute_force(docs):
    rows = families(1, groups=6, copies=25, changes=9)
    rows += [(5000, "One two three"), (5001, "one  TWO\tthree"), (5002, "one two"), (5003, "")]
    rows += [(5004, None), (5005, "  \n"), (None, rows[0][1]), (5006, "é É ﬁ"), (5007, "é É ﬁ")]
    rows += [(5008, "w " * 30_000), (5009, "w " * 29_000), (5001, "one two three")]
    rows += [(5010, "other words here now then"), (5010, "five six seven eight nine ten")]
    got = near_dedup.near_duplicates(docs(*rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_family_larger_than_a_block(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)
    rows = families(2, groups=2, copies=60, changes=8)
    got = near_dedup.near_duplicates(docs(*rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("copies", [2, 3])
def test_blocks_without_members(docs, monkeypatch, copies):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    rows = families(4, groups=20, copies=copies, changes=8)
    got = near_dedup.near_duplicates(docs(*rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_overlaps_in_column_chunks(monkeypatch):
    monkeypatch.setattr(near_dedup, "_COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    got = near_dedup._overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[4:]] for a in sets[:4]]


def test_empty_table_and_other_columns(docs):
    assert near_dedup.near_duplicates(docs()).collect() == []
    extra = docs((2, "a b c d e"), (1, "a b c d e"), extra=", component_id string, root int, n int", values=("x", 1, 2))
    kept = near_dedup.drop_near_duplicates(extra)
    assert kept.columns == extra.columns
    assert [r.doc_id for r in kept.collect()] == [1]
    assert near_dedup.drop_near_duplicates(docs()).collect() == []


def test_repeated_rows_stay_once(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")]
    kept = near_dedup.drop_near_duplicates(docs(*rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == [(0, "a b c d e f"), (1, "a b c d e f")]
    assert [r.doc_id for r in kept if not r.text] == [3]


def survivors(rows):
    """One (id, text) of each component of distinct texts, the least id, of equal ids the least md5."""
    documents = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda d: (d[0], md5(d[1])))
    found = brute([(n, t) for n, (_, t) in enumerate(documents)])
    return [d for n, d in enumerate(documents) if found[n][2] == n]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_texts_that_share_an_id_are_kept(docs):
    rows = families(5, groups=4, copies=6, changes=5)
    rows += [(7, "one text about boats and the sea"), (7, "another text about hills and sheep"), (7, rows[0][1])]
    rows += [(rows[8][0], "a text of its own that shares an id"), (-5, rows[14][1]), (-5, None), (-5, "")]
    rows += [(7, "one text about boats and the sea")]
    table = docs(*rows, extra=", _document string, _DOCUMENT2 int", values=("d", 1))
    kept = near_dedup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got) == sorted(survivors(rows))


def test_equal_documents_leave_the_same_row_always(docs):
    rows = docs((1, "a b c d e f")).selectExpr("* except (source)", "explode(array('z', 'b', 'm')) as source")
    for parts in (1, 3):
        (row,) = near_dedup.drop_near_duplicates(rows.repartition(parts)).collect()
        assert row.source == "b"


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)],
    }[shape]
    edges = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a bigint, b bigint")
    root = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert sorted(map(tuple, components(edges).collect())) == sorted((n, root[n]) for n in nodes)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
