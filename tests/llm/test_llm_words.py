import re

import numpy as np
import pyarrow as pa
import pytest

from packetlens.llm.words import ALPHANUMERIC, SPACED, hashed_words, shingles, text_blocks

TEXTS = ["Ab ab\tAB x", "", None, "  é-É, 9 ", "one two three four five six", "z" * 50, "\n\n"]
PATTERNS = {"spaced": (SPACED, r"[^\x20\x09-\x0D]+"), "plain": (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("kind", PATTERNS)
@pytest.mark.parametrize("size", [1, 30, 10_000])
def test_words_and_shingles(kind, size):
    table, pattern = PATTERNS[kind]
    known, seen, rows = {}, {}, 0
    for first, end, block, offsets in text_blocks(pa.array(TEXTS), size):
        words, at = hashed_words(block, offsets, table)
        runs, where = shingles(words, at, 5)
        for i in range(end - first):
            want = re.findall(pattern, lower(TEXTS[first + i]))
            got = words[at[i] : at[i + 1]].tolist()
            assert len(got) == len(want)
            for w, h in zip(want, got):
                assert known.setdefault(w, h) == h
            grams = [tuple(want[j : j + 5]) for j in range(max(len(want) - 4, min(len(want), 1)))]
            hashes = runs[where[i] : where[i + 1]].tolist()
            assert len(hashes) == len(grams)
            for g, h in zip(grams, hashes):
                assert seen.setdefault(g, h) == h
        rows += end - first
    assert rows == len(TEXTS)
    assert len(set(known.values())) == len(known) and len(set(seen.values())) == len(seen)


def test_case_is_kept_if_wanted():
    ((_, _, block, _),) = text_blocks(pa.array(["Ab"]), lower=False)
    assert block == b"Ab\n"


def test_shingle_depends_on_order_and_length():
    w = np.arange(1, 7, dtype=np.uint64)
    one, _ = shingles(w, np.array([0, 6]), 5)
    two, _ = shingles(w[::-1].copy(), np.array([0, 6]), 5)
    short, _ = shingles(w[:4], np.array([0, 4]), 5)
    assert len({*one.tolist(), *two.tolist(), *short.tolist()}) == 5
