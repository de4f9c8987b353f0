"""Interpolated modified Kneser-Ney bigram model: counted in Spark, memory-mapped by the workers.

Counting. Tasks hash words, count keys of their own texts and send each shard of the key space its
sorted keys and counts as two byte strings. A shard adds them up and writes them to the shared folder
as sorted arrays. Keys are spread by a hash, so a frequent word is no hot shard.

* vocabulary: sorted 64-bit word hashes and their counts; a word's id is its place over all shards
* bigrams: ``mix(context id << 32 | word id)`` sorted, with counts; ``mix`` is a bijection, so
  different bigrams never share a key
* by id, in parts: how often a word is a context, its back-off weight, and how many different
  contexts it follows

Scoring. Workers map the arrays of the shared folder read-only; a batch's keys are made distinct and
sorted before they are looked up, so pages are visited in order. Nothing of the model goes through
the driver but its totals and the sizes of shards.

Tokens are the words of a text (runs without white space, A-Z in lower case) and one end. The model
gives every word of the vocabulary and one unknown word a probability; they sum to one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize, new_folder
from .frames import map_arrow, utf8
from .words import SPACED, hashed_words, mix, text_blocks, unmix

END = mix(np.array([0x454E44], dtype=np.uint64))[0]  # the end of a text as a token

SHARD_BYTES = 16_000_000  # of text for each shard, so that a shard's keys fit a task
BUFFER_KEYS = 3_000_000  # keys that a task holds before it counts and sends them
PART_IDS = 1 << 16  # ids of a part of the arrays by id, so that a part is a small group

BLOCK_BYTES = 1_000_000  # of text that a task counts or scores at once
MOST = 0xFFFFFFFF  # of words in a vocabulary, and of occurrences of one bigram

COUNT_SCHEMA = "shard int, keys binary, counts binary"


# --- arrays in the shared folder ---


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Write whole or not at all: a task that is run again replaces the file by the same one."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    partial = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(partial) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    store.move(partial, f"{base}/{name}")


def _map(folder: str, name: str, kind) -> np.ndarray:
    """The array as a read-only map of its file.

    A folder that isn't a mounted path is copied first, to a file without a name that ends with the
    worker.
    """
    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.getsize(path):
            return np.zeros(0, dtype=kind)
        return np.memmap(path, dtype=kind, mode="r")
    with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as source:
        while chunk := source.read(1 << 24):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy, dtype=kind, mode="r") if copy.tell() else np.zeros(0, dtype=kind)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


@lru_cache(maxsize=8)
def _shards(folder: str, prefix: str, names: tuple[int, ...], kind: str) -> list[np.ndarray]:
    return [_map(folder, f"{prefix}-{k}", np.dtype(kind)) for k in names]


# --- counting ---


def _counted(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _send(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each shard; a key's shard is its first bits."""
    found, counts = _counted(keys, None)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cut = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([found[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()),
            pa.array([counts[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()),
        ],
        names=["shard", "keys", "counts"],
    )


def _count_keys(texts: DataFrame, keys_of, bits: int) -> DataFrame:
    """Count the keys that ``keys_of(words, first)`` makes of blocks of texts, by shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, block, offsets in text_blocks(batch.column(0), BLOCK_BYTES):
                keys = keys_of(*hashed_words(block, offsets, SPACED))
                held.append(keys)
                size += len(keys)
                if size >= BUFFER_KEYS:
                    yield _send(np.concatenate(held), bits)
                    held, size = [], 0
                    # Workers are used again: what Arrow keeps would come on top of all later work.
                    pa.default_memory_pool().release_unused()
        if size:
            yield _send(np.concatenate(held), bits)

    return map_arrow(texts, count, COUNT_SCHEMA)


def _added(group: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in group["keys"]])
    counts = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in group["counts"]])
    return int(group["shard"].iloc[0]), *_counted(keys, counts)


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of words in shards, and the id of each shard's first word."""

    folder: str
    shards: tuple[int, ...]
    first: tuple[int, ...]  # with the number of words last
    tokens: int  # of all training texts

    def __len__(self) -> int:
        return self.first[-1]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of sorted, distinct hashes; -1 where a word is unknown."""
        return _look_up(self.folder, "vocabulary", self.shards, self.first, words)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training occurrences of ids."""
        return _take(_shards(self.folder, "vocabulary-count", self.shards, "<i8"), self.first, ids)


def _take(arrays: list[np.ndarray], first: tuple[int, ...], ids: np.ndarray) -> np.ndarray:
    """Values of arrays laid end to end, at ids."""
    out = np.zeros(len(ids), dtype=arrays[0].dtype if arrays else np.int64)
    shard = np.searchsorted(np.array(first), ids, side="right") - 1
    for k in np.unique(shard):
        mine = shard == k
        out[mine] = arrays[k][ids[mine] - first[k]]
    return out


def _look_up(folder, prefix, shards, first, keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys in arrays laid end to end; -1 where they aren't there."""
    out = np.full(len(keys), -1, dtype=np.int64)
    arrays = _shards(folder, prefix, shards, "<u8")
    for k, array in enumerate(arrays):
        a, b = np.searchsorted(keys, array[[0, -1]])
        b = min(b + 1, len(keys))
        at = np.searchsorted(array, keys[a:b])
        inside = at < len(array)
        inside[inside] = array[at[inside]] == keys[a:b][inside]
        out[a:b][inside] = at[inside] + first[k]
    return out


def _fit_vocabulary(texts: DataFrame, folder: str, bits: int) -> Vocabulary:
    def keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.concatenate([words, np.full(len(first) - 1, END)])

    def write(group: pd.DataFrame) -> pd.DataFrame:
        shard, found, counts = _added(group)
        _write(folder, f"vocabulary-{shard}", found)
        _write(folder, f"vocabulary-count-{shard}", counts)
        return pd.DataFrame({"shard": [shard], "n": [len(found)], "total": [int(counts.sum())]})

    counted = _count_keys(texts, keys, bits)
    done = counted.groupBy("shard").applyInPandas(write, "shard int, n bigint, total bigint")
    rows = sorted(done.collect())
    first = np.concatenate([[0], np.cumsum([r.n for r in rows], dtype=np.int64)])
    return Vocabulary(
        folder,
        tuple(r.shard for r in rows),
        tuple(int(x) for x in first),
        sum(r.total for r in rows),
    )


def _bigrams(vocabulary: Vocabulary, words: np.ndarray, first: np.ndarray):
    """Contexts and tokens by id, -1 for unknown, and the index of each text's first token.

    The id after the last is the context at the start of a text.
    """
    found, place = np.unique(np.append(words, END), return_inverse=True)
    ids = vocabulary.ids(found)[place]
    texts = len(first) - 1
    at = np.asarray(first) + np.arange(texts + 1)
    token = np.full(at[-1], ids[-1], dtype=np.int64)
    inner = np.ones(at[-1], dtype=bool)
    inner[at[1:] - 1] = False
    token[inner] = ids[:-1]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[at[:-1]] = len(vocabulary)
    return context, token, at


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys seen once, twice, ... four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [
        1 - 2 * y * n2 / n1 if n1 else 0.5,
        2 - 3 * y * n3 / n2 if n2 else 1.0,
        3 - 4 * y * n4 / n3 if n3 else 1.5,
    ]
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


def _discount(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3)]


def _sums_by_id(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    return ids[first], np.add.reduceat(values, first, axis=0)


@dataclass(frozen=True)
class BigramModel:
    """Where the arrays are, and the totals needed beside them."""

    vocabulary: Vocabulary
    shards: tuple[int, ...]
    first: tuple[int, ...]
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_rest: float  # share of the continuation counts that discounts set free
    parts: tuple[int, ...] = field(default=())

    def _by_id(self, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
        arrays = _shards(self.vocabulary.folder, name, self.parts, kind)
        edges = tuple(PART_IDS * k for k in range(len(self.parts) + 1))
        return _take(arrays, edges, ids)

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Continuation probabilities, interpolated with the uniform one; -1 is unknown."""
        out = np.full(len(ids), self.lower_rest / (len(self.vocabulary) + 1))
        known = ids >= 0
        follows = self._by_id("follows", "<i8", ids[known])
        left = np.maximum(follows - _discount(follows, self.lower_discounts), 0)
        out[known] += left / max(self.first[-1], 1)
        return out

    def probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """P(token | context) by id."""
        found, place = np.unique(token, return_inverse=True)
        out = self.unigram(found)[place]
        known = np.flatnonzero(context >= 0)
        found, place = np.unique(context[known], return_inverse=True)
        total = self._by_id("context", "<i8", found)[place]
        rest = self._by_id("rest", "<f8", found)[place]
        seen = total > 0
        known, total, rest = known[seen], total[seen], rest[seen]
        out[known] *= rest
        both = token[known] >= 0
        known, total = known[both], total[both]
        keys, place = np.unique(_key(context[known], token[known]), return_inverse=True)
        folder = self.vocabulary.folder
        at = _look_up(folder, "bigram", self.shards, self.first, keys)
        counts = np.zeros(len(keys), dtype=np.int64)
        arrays = _shards(folder, "bigram-count", self.shards, "<u4")
        counts[at >= 0] = _take(arrays, self.first, at[at >= 0])
        left = np.maximum(counts - _discount(counts, self.discounts), 0)
        out[known] += left[place] / total
        return out


def _key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    pair = (context.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64)
    return mix(pair)


def _fit_bigrams(texts: DataFrame, vocabulary: Vocabulary, bits: int) -> BigramModel:
    folder = vocabulary.folder
    if len(vocabulary) >= MOST:
        raise ValueError(f"{len(vocabulary)} words, but a bigram's key holds ids below {MOST}.")

    def keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
        context, token, _ = _bigrams(vocabulary, words, first)
        return _key(context, token)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        shard, found, counts = _added(group)
        _write(folder, f"bigram-{shard}", found)
        if len(counts) and counts.max() > MOST:
            raise ValueError(f"A bigram occurs more than {MOST} times, beyond what its array holds.")
        _write(folder, f"bigram-count-{shard}", counts.astype("<u4"))
        pair = unmix(found)
        kinds = np.minimum(counts, 3)
        each = np.stack([counts, kinds == 1, kinds == 2, kinds == 3], axis=1).astype(np.int64)
        context, by_context = _sums_by_id((pair >> np.uint64(32)).astype(np.int64), each)
        token, by_token = _sums_by_id(
            (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), np.ones(len(pair), dtype=np.int64)
        )
        rows = []
        for kind, ids, values in (("context", context, by_context), ("token", token, by_token)):
            part = ids // PART_IDS
            for p in np.unique(part):
                mine = part == p
                rows.append((shard, kind, int(p), ids[mine].tobytes(), values[mine].tobytes()))
        sizes = [len(found), *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
        rows.append((shard, "size", 0, np.array(sizes, dtype=np.int64).tobytes(), b""))
        return pd.DataFrame(rows, columns=["shard", "kind", "part", "ids", "data"])

    counted = _count_keys(texts, keys, bits)
    schema = "shard int, kind string, part int, ids binary, data binary"
    stats = materialize(counted.groupBy("shard").applyInPandas(write, schema), "bigram-stats")
    sizes = sorted((r.shard, r.ids) for r in stats.filter("kind = 'size'").select("shard", "ids").collect())
    n = np.array([np.frombuffer(b, dtype=np.int64) for _, b in sizes]).reshape(-1, 5)
    discounts = _discounts([int(x) for x in n[:, 1:].sum(axis=0)])
    first = tuple(int(x) for x in np.concatenate([[0], np.cumsum(n[:, 0])]))

    def by_id(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        context = np.zeros((PART_IDS, 4), dtype=np.int64)
        follows = np.zeros(PART_IDS, dtype=np.int64)
        for kind, ids, data in zip(group["kind"], group["ids"], group["data"]):
            at = np.frombuffer(ids, dtype=np.int64) - part * PART_IDS
            values = np.frombuffer(data, dtype=np.int64)
            if kind == "context":
                context[at] += values.reshape(-1, 4)
            else:
                follows[at] += values
        rest = context[:, 1:] @ np.array(discounts) / np.maximum(context[:, 0], 1)
        _write(folder, f"context-{part}", context[:, 0])
        _write(folder, f"rest-{part}", rest)
        _write(folder, f"follows-{part}", follows)
        kinds = [int((follows == k).sum()) for k in (1, 2, 3, 4)]
        more = int((follows >= 3).sum())
        return pd.DataFrame([[part, *kinds, more]], columns=["part", "n1", "n2", "n3", "n4", "more"])

    # One part more than there are words: the context at a text's start has the id after the last.
    parts = range(len(vocabulary) // PART_IDS + 1)
    empty = texts.sparkSession.range(len(parts)).selectExpr(
        "0 shard", "'token' kind", "cast(id as int) part", "X'' ids", "X'' data"
    )
    pieces = stats.filter("kind <> 'size'").unionByName(empty)
    schema = "part int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint"
    done = pieces.groupBy("part").applyInPandas(by_id, schema)
    n1, n2, n3, n4, more = done.select(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4", "more")]
    ).first()
    lower = _discounts([n1, n2, n3, n4])
    free = lower[0] * n1 + lower[1] * n2 + lower[2] * more
    return BigramModel(
        vocabulary,
        tuple(s for s, _ in sizes),
        first,
        discounts,
        lower,
        free / first[-1] if first[-1] else 1.0,
        tuple(parts),
    )


def fit(docs: DataFrame, text_column: str = "text") -> BigramModel:
    """Count the texts of all rows of ``docs``. Null and empty texts count as one end each.

    More than ``MOST`` different words, or occurrences of one bigram, are an error.
    """
    texts = docs.select(utf8(text_column).alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(int(size // SHARD_BYTES).bit_length(), 3)
    folder = _uri(new_folder(docs.sparkSession, "language-model"))
    return _fit_bigrams(texts, _fit_vocabulary(texts, folder, bits), bits)


def _logs_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of log10 over each text's tokens; every text has at least its end."""
    return np.add.reduceat(np.log10(values), at[:-1])


def score(
    docs: DataFrame,
    model: BigramModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``score`` is the model's log10 probability of the text and its end, ``base_score`` that of
    counts plus one. A null text is scored as an empty one, which has one token, its end.
    """
    keep = keep or {}
    inputs = docs.select(
        utf8(text_column).alias("text"),
        F.col(f"`{id_column}`").alias(id_column),
        *[c.alias(n) for n, c in keep.items()],
    )
    added = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    kinds = ", ".join(f"`{n}` {t}" for n, t in inputs.dtypes[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.vocabulary
        n, v = vocabulary.tokens, len(vocabulary)
        for batch in batches:
            for start, end, block, offsets in text_blocks(batch.column(0), BLOCK_BYTES):
                words, first = hashed_words(block, offsets, SPACED)
                context, token, at = _bigrams(vocabulary, words, first)
                known = token >= 0
                counts = np.zeros(len(token))
                counts[known] = vocabulary.counts(token[known])
                base = _logs_by_text((counts + 1) / (n + v + 1), at)
                own = _logs_by_text(model.probability(context, token), at)
                tokens = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(start, end - start) for c in batch.columns[1:]],
                        pa.array(tokens),
                        pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])),
                        pa.array(np.full(end - start, n, dtype=np.int64)),
                        pa.array(base),
                        pa.array(own),
                        pa.array(10.0 ** np.minimum(-own / tokens, 300)),
                    ],
                    names=[*batch.schema.names[1:], *(x.split()[0] for x in added.split(", "))],
                )

    return map_arrow(inputs, run, f"{kinds}, {added}")
