import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packetlens.llm import packing


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(packing.public_vocabulary())


@pytest.fixture(scope="module")
def made():
    with open(packing.public_vocabulary(), encoding="utf-8") as file:
        return packing.Encoder(file.read())


def brute(public, text):
    return [*public.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(public, rows, pieces, capacity, least=1):
    """Every id lies in one piece, sequences have no gaps, and padding is what the rule allows."""
    wanted = {i: brute(public, t) for i, t in rows}
    got = {i: [None] * len(ids) for i, ids in wanted.items()}
    sequences = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length and p.doc_tokens == len(wanted[p.doc_id])
        place = got[p.doc_id]
        assert place[p.start : p.start + p.length] == [None] * p.length
        place[p.start : p.start + p.length] = ids
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == wanted
    padding = 0
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
        padding += -end % capacity if end & (end - 1) else 0
    if least == 1:
        assert padding == 0
    return sequences


def test_every_id_in_one_piece_without_padding(spark, docs, public):
    rows = [(i, "word and another, 12 " * (i * 7 % 400)) for i in range(150)] + [(900, None), (901, "")]
    packed = packing.pack(docs(*rows)).collect()
    sequences = check(public, rows, packed, packing.CAPACITY)
    tokens = sum(p.length for p in packed)
    short = [s for s in sequences.values() if sum(n for _, n in s) < packing.CAPACITY]
    workers = len({p.sequence_id >> 33 for p in packed})
    assert len(short) <= 10 * workers
    assert len(sequences) - len(short) >= tokens // packing.CAPACITY - workers


def test_least_cuts_less_and_pads_less_than_it(spark, docs, public):
    rows = [(i, "some text of words " * (i % 37)) for i in range(80)]
    packed = packing.pack(docs(*rows), capacity=256, least=32).collect()
    check(public, rows, packed, 256, least=32)
    last = {}
    for p in packed:
        last[p.doc_id] = max(last.get(p.doc_id, (0, 0)), (p.start, p.length))
    for p in packed:
        assert p.length >= 32 or (p.start, p.length) == last[p.doc_id]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=20), st.sampled_from([1, 2, 8, 64]))
def test_cut_lengths_cover_documents(tokens, least):
    tokens = np.array(tokens, dtype=np.int64)
    document, start, length, slot = packing.cut_lengths(tokens, 64, least)
    for i, n in enumerate(tokens):
        mine = document == i
        assert length[mine].sum() == n
        assert start[mine].tolist() == (np.cumsum(length[mine]) - length[mine]).tolist()
    assert np.all(slot >= length) and np.all(slot - length < least)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_library(made, public, text):
    assert made.ids(text).tolist() == public.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["word " * 60_000, "x" * 130_000, " " * 260_000, "a b\n" * 60_000 + "<|endoftext|> end", "é漢 1" * 50_000],
)
def test_ids_of_very_long_texts(made, public, text):
    assert made.ids(text).tolist() == public.encode(text, add_special_tokens=False).ids


def test_ties_repeats_clashing_names_and_empty_tables(spark, docs, public):
    names = ", start bigint, ids string, sequence_id bigint, id int"
    rows = [(1, "same text"), (1, "same text"), (None, "of nobody"), (None, None)]
    packed = packing.pack(docs(*rows, extra=names, values=(7, "x", 8, 9))).collect()
    assert sum(p.length for p in packed) == sum(len(brute(public, t)) for _, t in rows)
    assert packing.pack(docs()).collect() == []
    ids = spark.createDataFrame([("a", "b c")], "start string, text string")
    assert packing.pack(ids, id_column="start").count() >= 1


def test_digest_is_that_of_the_ids(spark, docs):
    rows = docs(*[(i, "many words here " * i) for i in range(60)])
    keys = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    full = {tuple(p[k] for k in keys): zlib.crc32(p.ids) for p in packing.pack(rows).collect()}
    short = {tuple(p[k] for k in keys): p.ids_crc32 for p in packing.pack(rows, digest=True).collect()}
    assert full == short


def test_powers_of_two_only(docs):
    with pytest.raises(ValueError):
        packing.pack(docs((1, "a")), capacity=1000)
    with pytest.raises(ValueError):
        packing.pack(docs((1, "a")), capacity=64, least=128)
