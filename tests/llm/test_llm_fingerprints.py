import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from packetlens.llm import fingerprints as fp


def hash_text(text):
    hashed = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return (hashed - (1 << 64) if hashed >> 63 else hashed) % fp.P


def units(text):
    runs = re.findall(r"[^\W_]+", (text or "").lower())
    return [u for r in runs for u in ([r] if len(r) <= fp.LONG else r)]


def rolled(u):
    """Hashes of all runs of K numbers, each from the one before it."""
    value = 0
    for x in u[: fp.K]:
        value = (value * fp.B + x) % fp.P
    found = [value]
    for gone, new in zip(u, u[fp.K :]):
        value = ((value - gone * pow(fp.B, fp.K - 1, fp.P)) * fp.B + new) % fp.P
        found.append(value)
    return found


def winnow(text):
    text = text or ""
    u = [hash_text(x) for x in units(text)]
    if len(u) >= fp.K:
        grams = [(h, i) for i, h in enumerate(rolled(u))]
    elif u:
        grams = [(hash_text(" ".join(map(str, u))), 0)]
    else:
        grams = [(hash_text(text), 0)] if text else []
    chosen = []
    for i in range(max(len(grams) - fp.W + 1, min(len(grams), 1))):
        window = grams[i : i + fp.W]
        least = min(h for h, _ in window)
        best = max(p for h, p in window if h == least)
        if not chosen or chosen[-1] != (least, best):
            chosen.append((least, best))
    return chosen


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def rows_of(entries):
    return [(int(h, 16), int(p)) for h, p in (x.split(":") for x in entries.split())]


@pytest.fixture
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 14)))
    made = [(i * 7 - 50, " ".join(word() for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    made += [(2000, None), (2001, ""), (2002, "?!"), (2003, "one"), (2004, "a a a a a a a a a")]
    made += [(2005, "long " * 20_000), (2006, "x" * 50_000), (None, "no id here at all"), (2007, "a, b")]
    return [*made, made[3], (made[5][0], "another text of the same id"), (2008, "漢字とかな ÀÉ")]


@pytest.mark.parametrize("bucket", [1000, 5])
def test_equals_brute_force(docs, rows, bucket, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", bucket)
    table = docs(*rows, extra=", next string, own int, _bucket int", values=("n", 1, 2))
    got = fp.edited_fingerprints(table).select(
        "*", fp.as_text(F.col("entries")).alias("a"), fp.as_text(F.col("edited_entries")).alias("b")
    )
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), (r[1] or "").encode()))
    want = []
    for i, (identity, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        prints = [winnow(x) for x in (text, edited, after)]
        near = (round(jaccard(prints[0], prints[1]), 9), round(jaccard(prints[0], prints[2]), 9))
        want.append((str(identity), len(text), edited, prints[0], prints[1], *near))
    rest = [
        (str(r.doc_id), r.n_chars, r.edited, rows_of(r.a), rows_of(r.b), round(r.near_edited, 9), round(r.near_next, 9))
        for r in got.collect()
    ]
    assert sorted(rest) == sorted(want)


def test_match_guarantee(docs):
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(fp.K + fp.W - 1)]
    texts = []
    for _ in range(40):
        pad = lambda: [f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        texts.append(" ".join([*pad(), *shared, *pad()]))
    out = fp.with_fingerprint(docs(*enumerate(texts)), F.col("text"), "entries")
    sets = [{h for h in r.h} for r in out.select(fp.hashes(F.col("entries")).alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)


@pytest.mark.parametrize("k", [1, 2, 4, 5, 7, 8])
def test_rolling_hash_of_any_length(spark, k, monkeypatch):
    monkeypatch.setattr(fp, "K", k)
    rng = random.Random(k)
    u = [rng.randrange(fp.P) for _ in range(60)]
    (row,) = spark.createDataFrame([(u,)], "u array<bigint>").select(fp._rolling(F.col("u"), k).alias("h")).collect()
    assert row.h == rolled(u)


@pytest.mark.parametrize("signs", ["".join(map(chr, range(0x4E00, 0x5000))), "abcXYZ0189KLMpqr"])
def test_shifted_text_without_spaces(docs, signs):
    rng = random.Random(11)
    run = "".join(rng.choice(signs) for _ in range(4000))
    for ahead in range(1, 8):
        table = docs((2, run), (1, run[:ahead] + run))
        near = {r.doc_id: r.near_next for r in fp.edited_fingerprints(table).collect()}
        assert near[2] > 0.98


def test_texts_of_marks_only(docs):
    got = fp.edited_fingerprints(docs((4, "?!"), (3, "..."), (2, "..."), (1, ""))).collect()
    assert {r.doc_id: r.near_next for r in got} == {4: 0.0, 3: 1.0, 2: 0.0, 1: 0.0}


def test_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 5)
    rows = [(f"d{i * 37 % 100:02d}", f"text number {i} of {i * i}") for i in range(100)] + [(None, "no id")]
    got = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted(rows[:-1], reverse=True) + rows[-1:]
    after = {a: b[1] for (a, _), b in zip(order, order[1:] + order[:1])}
    texts = dict(rows)
    for r in got:
        third = len(texts[r.doc_id]) // 3
        assert r.edited == texts[r.doc_id][: len(texts[r.doc_id]) - third] + after[r.doc_id][:third]


def test_empty_and_single(docs):
    assert fp.edited_fingerprints(docs()).collect() == []
    (row,) = fp.edited_fingerprints(docs((5, "abcdef"))).collect()
    assert row.edited == "abcdab" and row.near_next == 1
