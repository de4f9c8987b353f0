"""Words of UTF-8 texts as 64-bit hashes, for whole Arrow batches at once.

All passes are vectorised over the bytes of a batch, so a word costs some tens of nanoseconds and no
Python object. A word's hash depends only on its bytes: equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes taken at once: bounds the memory of a task, whatever the size of a batch or a text.
BLOCK_BYTES = 2_000_000

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)


def byte_set(wanted) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[b for b in range(256) if wanted(b)]] = True
    return table


# Words between white space: [^\x20\x09-\x0D]+
SPACED = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Words of letters, digits and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, lower case
ALPHANUMERIC = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


class _Powers:
    """Powers of the base and their inverses modulo 2**64, made once for each worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def at_least(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full(n - 1, _BASE, dtype=np.uint64)
            back = np.full(n - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            one = np.ones(1, dtype=np.uint64)
            cls.up = np.concatenate([one, np.cumprod(steps)])
            cls.down = np.concatenate([one, np.cumprod(back)])
        return cls.up, cls.down


def word_spans(data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = word_bytes[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes."""
    up, down = _Powers.at_least(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def text_blocks(
    texts: pa.Array, block_bytes: int = BLOCK_BYTES, lower: bool = True
) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about ``block_bytes``, at least one text each.

    Yields first and last row (exclusive), the texts each followed by a line break, A-Z in lower
    case if so wanted, and the offset of each text's first byte with the end of the block last. Null is empty.
    """
    values = [b"" if v is None else v for v in texts.cast(pa.large_binary()).to_pylist()]
    first, size = 0, 0
    for at in range(len(values) + 1):
        if at == len(values) or (size and size + len(values[at]) > block_bytes):
            if at > first:
                chosen = values[first:at]
                lengths = np.fromiter((len(v) + 1 for v in chosen), dtype=np.int64, count=at - first)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                block = b"\n".join([*chosen, b""])
                yield first, at, block.translate(_LOWER) if lower else block, offsets
            first, size = at, 0
        if at < len(values):
            size += len(values[at]) + 1


def hashed_words(
    block: bytes, offsets: np.ndarray, word_bytes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and the index of each text's first word with the end last."""
    data = np.frombuffer(block, dtype=np.uint8)
    starts, ends = word_spans(data, word_bytes)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(
    words: np.ndarray, first: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, and each text's first with the end last.

    A text of fewer words has one shingle, the whole of it; a text without words has none.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1], runs) + np.repeat(first[:-1], runs)
    length = np.minimum(np.repeat(count, runs), size)
    total = np.zeros(int(at[-1]), dtype=np.uint64)
    short = np.flatnonzero(length < size)
    with np.errstate(over="ignore"):
        for j in range(size):
            take = begin + j
            if len(short):
                take = np.minimum(take, len(words) - 1)
            part = words[take] if len(words) else total
            if len(short):
                part = np.where(length > j, part, np.uint64(0))
            total = total * _GAMMA + part
        return mix(total + length.astype(np.uint64)), at
