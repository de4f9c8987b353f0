"""Token counts of sections by offset mapping: whole texts are encoded once.

A byte-level vocabulary's tokens, laid end to end, are exactly the text's bytes, so the token ids give
every token's span. The spans are joined with the spans of the text's sections (interval join on two
sorted lists). A token that crosses a border goes by an explicit rule:

* ``start``, ``middle``, ``end``: to each section that holds its first, middle (of an even number the
  earlier) or last byte, so to exactly one of adjoining sections
* shares (column ``share``, always given): to each section the part of the token's bytes inside it

Tokens that no section claims are reported as section -1, so that nothing is lost.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts text into pieces, as published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RULES = ("start", "middle", "end")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """A tokenizer and the byte length of each of its tokens, loaded once by a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return made, lengths


def attribute(
    ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and shares of sections ``[begin, stop)``, for tokens that end at ``ends``, in bytes."""
    start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    point = {"start": start, "middle": (start + ends - 1) // 2, "end": ends - 1}[rule]
    tokens = np.searchsorted(point, stop) - np.searchsorted(point, begin)
    knots = np.concatenate([[0], ends])
    before = np.interp(np.stack([begin, stop]), knots, np.arange(len(knots)))
    return np.where(stop > begin, tokens, 0), before[1] - before[0]


def _lines(text: bytes) -> list[tuple[int, int]]:
    """Lines with their breaks, in bytes: they adjoin and cover the text."""
    cut = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    edges = [0, *cut.tolist()]
    if edges[-1] < len(text) or len(edges) == 1:
        edges.append(len(text))
    return list(zip(edges[:-1], edges[1:]))


def _unclaimed(size: int, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gaps that sections leave in a text."""
    change = np.zeros(size + 1, dtype=np.int64)
    full = stop > begin
    np.add.at(change, begin[full], 1)
    np.add.at(change, stop[full], -1)
    free = np.concatenate([[False], np.cumsum(change)[:size] == 0, [False]]).astype(np.int8)
    step = np.diff(free)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def section_tokens(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sections: Column | None = None,
    rule: str = "start",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """One row per section of each row of ``docs``: id, section, begin, stop, n_tokens, share.

    ``sections`` is an array of structs ``(begin, stop)`` in characters, in any order, which may
    overlap; they are numbered from 0. Spans beyond the text are cut, null spans are empty. Without
    it the sections are the text's lines, each with its break. ``n_tokens`` goes by ``rule``.
    Section -1, only where it isn't empty, holds tokens that no section claims. Null and empty texts
    have no tokens; their lines are one empty section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spans = sections if sections is not None else F.lit(None).cast("array<struct<begin:bigint,stop:bigint>>")
    inputs = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
        spans.alias("spans"),
    )
    by_lines = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = encoding(vocabulary, pattern)
        for batch in batches:
            parts, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                ends = np.cumsum(lengths[encoder.encode_ordinary(text)])
                # The first byte of each character, and the end.
                head = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
                head = np.append(head, len(data))
                if by_lines:
                    edges = np.array(_lines(data), dtype=np.int64)
                else:
                    given = batch.column("spans")[i].as_py() or []
                    known = [s and (s["begin"], s["stop"]) for s in given]
                    pairs = [(0, 0) if not s or None in s else s for s in known]
                    chars = np.clip(np.array(pairs, dtype=np.int64).reshape(-1, 2), 0, len(head) - 1)
                    edges = head[chars]
                begin, stop = edges[:, 0], np.maximum(edges[:, 1], edges[:, 0])
                tokens, share = attribute(ends, begin, stop, rule)
                number = np.arange(len(begin))
                low, high = _unclaimed(len(data), begin, stop)
                if len(low):
                    rest, part = attribute(ends, low, high, rule)
                    number = np.append(number, -1)
                    begin, stop = np.append(begin, low[0]), np.append(stop, high[-1])
                    tokens, share = np.append(tokens, rest.sum()), np.append(share, part.sum())
                characters = np.searchsorted(head, np.stack([begin, stop]))
                parts.append((number, *characters, tokens, share))
                rows.append(np.full(len(number), i))
            if not parts:
                continue
            number, begin, stop, tokens, share = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.concatenate(rows))),
                    pa.array(number, pa.int32()),
                    pa.array(begin, pa.int64()),
                    pa.array(stop, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(share, pa.float64()),
                ],
                names=["id", "section", "begin", "stop", "n_tokens", "share"],
            )

    kind = dict(inputs.dtypes)["id"]
    schema = f"id {kind}, section int, begin bigint, stop bigint, n_tokens bigint, share double"
    return map_arrow(inputs, run, schema).withColumnRenamed("id", id_column)
