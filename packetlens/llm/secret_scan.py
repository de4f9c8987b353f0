"""Secrets in texts: known forms, and random strings found by their token efficiency.

A vocabulary of byte pairs spends few tokens on words and names it has seen, and nearly one for each
character or two on random ones. So long runs of key characters that have few characters to a token
are reported, and of others the stretches that have: a name or path in front is words, which end one.
Known forms that only look random are cut out before: digests of the usual lengths, UUIDs, numbers.
Whether something is a word is left to the vocabulary alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_arrow
from .token_counts import PATTERN, VOCABULARY, encoding

KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 6, 20, 24, 16
CHARS_PER_TOKEN = 2.0
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # hexadecimal digits of md5, sha1 and sha2

# The forms of the base search.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")

_DROP = 8  # characters beyond the bound that end a stretch: one long word, or two short ones
_SHORT = 3  # tokens of so many characters at a stretch's edge may be a part of it

_SEPARATORS = "+/_=-"
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}")
_DIGITS = "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in DIGEST_LENGTHS)
# What ends a run: rulers, UUIDs, and digests in one case.
_KNOWN = re.compile(
    rf"[+/_=-]{{3,}}|(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{{8}}-(?:[0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}"
    rf"|(?![0-9]*[a-z][0-9a-z]*[A-Z]|[0-9]*[A-Z][0-9A-Z]*[a-z])(?:{_DIGITS}))(?![0-9A-Za-z])"
)
_LETTER = re.compile(r"[A-Za-z]")


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base forms; leftmost, not overlapping within a kind."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE
    ]
    found += [
        (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS
    ]
    # A run of these characters that is long enough is matched from its first: runs have no others.
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def _free(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of runs that hold no span of ``taken`` and nothing known, if long enough."""
    spans, at = sorted((s, e) for s, _, e in taken), 0
    for m in _RUN.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        cuts = [(k.start(), k.end()) for k in _KNOWN.finditer(text, m.start(), m.end())]
        i = at
        while i < len(spans) and spans[i][0] < m.end():
            cuts.append(spans[i])
            i += 1
        start = m.start()
        for s, e in [*sorted(cuts), (m.end(), m.end())]:
            if s - start >= LEAST_RANDOM:
                yield start, s
            start = max(start, e)


def _stretches(gain: list[float]) -> Iterator[tuple[int, int]]:
    """Stretches of positive sum, each up to its best end, that no fall of ``_DROP`` lies in."""
    at = 0
    while at < len(gain):
        if gain[at] <= 0:
            at += 1
            continue
        total = best = 0.0
        end = at
        for i in range(at, len(gain)):
            total += gain[i]
            if total > best:
                best, end = total, i + 1
            if total <= 0 or total <= best - _DROP:
                break
        yield at, end
        at = end


def random_spans(text: str, taken: list[tuple[int, int, int]], encoder, bound: float) -> list:
    """Runs outside of ``taken`` and known forms that have few characters to a token, or their stretches.

    A run is one span if it has few as a whole; else each stretch of it that has is one. In stretches
    separators are no characters of a word nor of a number, so they count for nothing.
    """
    found = []
    for begin, stop in _free(text, taken):
        run = text[begin:stop]
        size = [len(t) for t in encoder.decode_tokens_bytes(encoder.encode_ordinary(run))]
        if len(run) < bound * len(size):
            if _LETTER.search(run):
                found.append((begin, 3, stop))
            continue
        edge = [0, *accumulate(size)]
        plain = [run[a] not in _SEPARATORS for a in edge[:-1]]
        gain = [bound - n if p else 0.0 for n, p in zip(size, plain)]
        first, end = plain.index(True), len(plain) - plain[::-1].index(True)
        last = 0
        for i, j in _stretches(gain):
            total = sum(gain[i:j])
            # So short a token at an edge is likelier a part of the key than a word.
            while i > last and plain[i - 1] and size[i - 1] <= _SHORT and total + gain[i - 1] > 0:
                i, total = i - 1, total + gain[i - 1]
            while j < len(size) and plain[j] and size[j] <= _SHORT and total + gain[j] > 0:
                j, total = j + 1, total + gain[j]
            # Separators at the ends of a run belong to it, as in base64.
            i, j = 0 if i == first else max(i, last), len(size) if j == end else j
            a, b, last = edge[i], edge[j], max(j, last)
            if b - a >= LEAST_RANDOM and _LETTER.search(run, a, b):
                found.append((begin + a, 3, begin + b))
    return found


def find_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of ``(kind, start, stop)``.

    Spans are in characters, sorted by start and, for equal starts, in the order of ``KINDS``. Null
    and empty texts have none. Each text is searched whole.
    """
    inputs = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = encoding(vocabulary, pattern)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = known_spans(text or "")
                spans = sorted(base + random_spans(text or "", base, encoder, chars_per_token))
                out.append([{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out, _SPANS)], names=["id", "spans"]
            )

    kind = dict(inputs.dtypes)["id"]
    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint>>"
    return map_arrow(inputs, run, schema).withColumnRenamed("id", id_column)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
