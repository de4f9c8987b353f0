"""Sequences of one capacity for training, filled by classes of reciprocal length.

A class holds slots of capacity / k tokens, and a bin of the class holds always k of them: no bin is
searched, so a worker packs its rows alone, in one pass and with some hundred pieces in memory. Only
the divisors of a power of two are used as k, since their bins are full to the last token. A document
is cut into pieces that fill slots: whole sequences first, then each binary digit of the rest.

At the end of its rows a worker has less than one bin of each class. These pieces, longest first, fill
whole sequences again, and what is left becomes one sequence for each binary digit of its length. So a
worker makes at most one short sequence of each class, and each has a power of two as its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import byte_blocks
from .token_counts import PATTERN

CAPACITY = 1024
# Closes every document.
END = 0
# Rows of the result sent at once, and bytes of text encoded at once.
OUT_PIECES = 20_000
TEXT_BYTES = 4_000_000

# Longer texts are encoded in parts of this many characters, each cut where two tokens always part:
# in byte-level vocabularies no token holds a space after another character that isn't a space.
_PART = 50_000
_BORDER = re.compile(r"[0-9A-Za-z](?= )")


def public_vocabulary() -> str:
    """Where the public byte-level vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: a visible byte is its own letter."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in visible}
    hidden = sorted(set(range(256)) - set(visible))
    return letters | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Token ids of a vocabulary file of the library ``tokenizers``, given as its text.

    A byte-level BPE whose ids are ordered like its merges is encoded with ``tiktoken``, which has
    the same result four times as fast; all else, and parts without any border, with ``tokenizers``.
    """

    def __init__(self, source: str):
        self.source = source
        described = json.loads(source)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        self.fast = self._fast(described)

    @staticmethod
    def _fast(described: dict):
        import tiktoken

        model, cut = described["model"], described.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [model["vocab"].get("".join(m), -1) for m in merges]
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not described.get("normalizer")
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex")
            and not cut.get("add_prefix_space")
            and min(ids, default=-1) >= 0
            and ids == sorted(ids)
        )
        if not plain:
            return None
        letters = _byte_letters()
        special = {t["content"] for t in described.get("added_tokens", [])}
        ranks = {
            bytes(letters[c] for c in token): n
            for token, n in model["vocab"].items()
            if token not in special
        }
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    def _exactly(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self._exactly(text), dtype="<u4")
        parts, at = [np.zeros(0, dtype="<u4")], 0
        while at < len(text):
            border = _BORDER.search(text, at + _PART) if len(text) - at > _PART else None
            stop = border.end() if border else len(text)
            part = text[at:stop]
            found = self.fast.encode_ordinary(part) if stop - at <= 2 * _PART else self._exactly(part)
            parts.append(np.array(found, dtype="<u4"))
            at = stop
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(source: str) -> Encoder:
    return Encoder(source)


def cut_lengths(
    tokens: np.ndarray, capacity: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of so many tokens: document, start, length and slot, by document and start.

    Only a document's last piece may be shorter than its slot, by less than ``least``.
    """
    slots = -(-tokens // least) * least
    whole = slots // capacity
    document = [np.repeat(np.arange(len(tokens)), whole)]
    first = np.cumsum(whole) - whole
    start = [(np.arange(whole.sum()) - np.repeat(first, whole)) * capacity]
    slot = [np.full(int(whole.sum()), capacity)]
    size = capacity // 2
    while size >= least:
        has = np.flatnonzero(slots & size)
        document.append(has)
        start.append(slots[has] // (2 * size) * (2 * size))
        slot.append(np.full(len(has), size))
        size //= 2
    document, start, slot = (np.concatenate(x) for x in (document, start, slot))
    order = np.lexsort((start, document))
    document, start, slot = document[order], start[order], slot[order]
    return document, start, np.minimum(slot, tokens[document] - start), slot


def _placed(pieces: pa.Table, sequence: np.ndarray) -> pa.Table:
    """Pieces with their sequences, which are in order, and offsets."""
    length = pieces.column("length").to_numpy()
    before = np.cumsum(length) - length
    first = np.concatenate([[True], sequence[1:] != sequence[:-1]]) if len(sequence) else sequence == 0
    offset = before - np.maximum.accumulate(np.where(first, before, 0))
    return pieces.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
        "offset", pa.array(offset, pa.int64())
    )


class _Bins:
    """One worker's open bins: fewer pieces of each class than a bin holds."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity = capacity
        self.next_id = first_id
        self.open: dict[int, pa.Table] = {}

    def add(self, pieces: pa.Table, slot: np.ndarray) -> Iterator[pa.Table]:
        """Full bins of all classes, once these pieces have come."""
        for size in np.unique(slot).tolist():
            mine = pieces.take(pa.array(np.flatnonzero(slot == size)))
            if size in self.open:
                mine = pa.concat_tables([self.open.pop(size), mine])
            count = self.capacity // size
            bins = mine.num_rows // count
            if bins:
                sequence = self.next_id + np.arange(bins * count) // count
                self.next_id += bins
                yield _placed(mine.slice(0, bins * count), sequence)
            if mine.num_rows > bins * count:
                # Taken, so copied: a slice would keep all of its parent in memory.
                self.open[size] = mine.take(pa.array(np.arange(bins * count, mine.num_rows)))

    def close(self) -> Iterator[pa.Table]:
        """What is open, longest first: full sequences, then one for each binary digit of the rest.

        Slots are powers of two in descending order, so every border of sequences is one of slots.
        """
        sizes = sorted(self.open, reverse=True)
        if not sizes:
            return
        pieces = pa.concat_tables([self.open[s] for s in sizes])
        slot = np.repeat(sizes, [self.open[s].num_rows for s in sizes])
        total = int(slot.sum())
        parts = [self.capacity] * (total // self.capacity)
        parts += [self.capacity >> k for k in range(1, self.capacity.bit_length()) if total & (self.capacity >> k)]
        sequence = np.searchsorted(np.cumsum(parts), np.cumsum(slot) - slot, side="right")
        yield _placed(pieces, self.next_id + sequence)


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    least: int = 1,
    end: int = END,
    vocabulary: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs``, dealt to sequences of at most ``capacity`` tokens.

    Returns one row per piece: the id, ``start`` (tokens of the document before it), ``length``,
    ``ids`` (its token ids, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
    ``offset`` (tokens before it in the sequence). A document's tokens are its text's and ``end``;
    each is in exactly one piece. A sequence has a power of two of tokens, most often ``capacity``:
    without padding if ``least`` is 1. With a larger ``least`` documents are cut less, as no slot is
    shorter, and pad less than that many tokens each. Both must be powers of two.

    With ``digest`` a piece has ``ids_crc32``, the crc32 of ``ids``, in their place: a plan of the
    sequences that is small beside them, for a writer that encodes the texts itself.

    Null and empty texts have the token ``end`` alone. Ids may be null, repeated and of any type: rows
    with one id are documents of their own, whose pieces the ids don't tell apart. Sequences never span
    tasks, so a task that runs again changes none but its own; their numbers depend on the splits.
    Other columns are ignored.
    """
    for value in (capacity, least):
        if value < 1 or value & (value - 1):
            raise ValueError("capacity and least must be powers of two")
    if least > capacity:
        raise ValueError("least must not exceed capacity")
    with open(vocabulary or public_vocabulary(), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    inputs = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )
    content = "ids_crc32" if digest else "ids"
    names = ["id", "start", "length", content, "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(shared.value)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 33)
        closing = np.array([end], dtype="<u4")
        for batch in batches:
            for rows in byte_blocks(batch, "text", TEXT_BYTES):
                ids = [
                    np.concatenate([made.ids(text), closing]) if text else closing
                    for text in rows.column("text").to_pylist()
                ]
                tokens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                base = np.cumsum(tokens) - tokens
                data = memoryview(np.concatenate(ids).tobytes())
                document, start, length, slot = cut_lengths(tokens, capacity, least)
                low = base[document] + start
                cut = [data[4 * a : 4 * b] for a, b in zip(low.tolist(), (low + length).tolist())]
                if digest:
                    ids_column = pa.array(list(map(zlib.crc32, cut)), pa.int64())
                else:
                    ids_column = pa.array(cut, pa.binary())
                pieces = pa.table(
                    {
                        "id": rows.column("id").take(pa.array(document)),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        content: ids_column,
                        "doc_tokens": pa.array(tokens[document], pa.int64()),
                    }
                )
                for full in bins.add(pieces, slot):
                    yield from full.select(names).to_batches(max_chunksize=OUT_PIECES)
        for rest in bins.close():
            yield from rest.select(names).to_batches()

    kind = dict(inputs.dtypes)["id"]
    schema = (
        f"id {kind}, start bigint, length bigint, {content} {'bigint' if digest else 'binary'},"
        " doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return inputs.mapInArrow(run, schema).select(F.col("id").alias(id_column), *names[1:])
