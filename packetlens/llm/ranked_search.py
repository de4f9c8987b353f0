"""Ranked lexical search, reversed: the items are indexed, and the documents stream past them.

The items' terms make an inverted index that is broadcast in blocks of bounded size. A first pass
counts the documents, their terms and, for the index's terms, the documents that hold them. A second
pass sends each document's term counts through the index, adds up a score for each item that shares a
term, and keeps the best documents of each item in a bounded heap per task. The heaps are merged in a
tree. No document is shuffled, no posting of documents is stored, and all documents are scored.

Score of a document for an item, in 64-bit integers with ``div`` rounding down: the sum over the
item's terms of ``w * (10^9 tf div (1000 tf + 8 m))``, where ``w = floor(1000 ln((2N+2)/(2df+1)))``
and ``m = 10 + 90 n N div L`` for N documents with terms, L terms in all and n in the document.

Terms are compared by 64-bit hashes: with 10^10 different words in the documents and 10^5 terms in a
block, any two collide with a probability of 5 in 100,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .frames import byte_blocks, utf8
from .words import ALPHANUMERIC, hashed_words, text_blocks

TOP = 10
# Bytes of items in a block of the index, with what an item needs besides its text.
BLOCK_BYTES = 2_000_000
ITEM_BYTES = 64
# Cells of documents by items, and postings followed, at once in a task.
CELLS = 2_000_000
# Heaps merged in one group.
FAN_IN = 256
_TEXT_BYTES = 8_000_000


@dataclass
class Index:
    """Postings of a block: the items of term ``i`` are ``items[first[i]:first[i + 1]]``."""

    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    numbers: np.ndarray

    @property
    def n_items(self) -> int:
        return len(self.numbers)

    @classmethod
    def of(cls, texts: pa.Array, numbers: np.ndarray) -> Index:
        terms, items = [], []
        for low, high, block, offsets in text_blocks(texts):
            words, first = hashed_words(block, offsets, ALPHANUMERIC)
            terms.append(words)
            items.append(np.repeat(np.arange(low, high), np.diff(first)))
        found = np.concatenate(terms) if terms else np.zeros(0, dtype=np.uint64)
        unique, place = np.unique(found, return_inverse=True)
        pairs = np.unique(place * max(len(texts), 1) + (np.concatenate(items) if items else place))
        term, item = np.divmod(pairs, max(len(texts), 1))
        return cls(unique, np.searchsorted(term, np.arange(len(unique) + 1)), item, numbers)


def _counts(texts: pa.Array, terms: np.ndarray) -> Iterator[tuple]:
    """Blocks of texts: first row, terms of each row, and rows, terms and counts of shared terms."""
    for low, _, block, offsets in text_blocks(texts):
        words, first = hashed_words(block, offsets, ALPHANUMERIC)
        n = np.diff(first)
        if not len(terms):
            none = np.zeros(0, dtype=np.int64)
            yield low, n, none, none, none
            continue
        place = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
        shared = np.flatnonzero(terms[place] == words)
        row = np.searchsorted(first, shared, side="right") - 1
        pairs, tf = np.unique(row * len(terms) + place[shared], return_counts=True)
        row, term = np.divmod(pairs, len(terms))
        yield low, n, row, term, tf


def _statistics(docs: DataFrame, terms) -> dict[int, tuple[int, int]]:
    """For each shared term its documents; under -1 the documents with terms, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = terms.value
        df, documents, words = np.zeros(len(index), dtype=np.int64), 0, 0
        for batch in batches:
            for rows in byte_blocks(batch, "text", _TEXT_BYTES):
                for _, n, _, term, _ in _counts(rows.column("text"), index):
                    df += np.bincount(term, minlength=len(index))
                    documents += int(np.count_nonzero(n))
                    words += int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(held, -1), pa.int32()),
                pa.array(np.append(df[held], documents), pa.int64()),
                pa.array(np.append(np.zeros(len(held), dtype=np.int64), words), pa.int64()),
            ],
            names=["term", "documents", "words"],
        )

    partial = docs.select("text").mapInArrow(run, "term int, documents bigint, words bigint")
    total = partial.groupBy("term").agg(F.sum("documents"), F.sum("words"))
    return {r[0]: (r[1], r[2]) for r in total.collect()}  # at most a row for each term of the block


def weight(documents: int, held_by: int) -> int:
    """The integer weight of a term that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held_by + 1)))


def score_rows(
    index: Index, weights: np.ndarray, documents: int, words: int, n, row, term, tf
) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of rows by items, in runs of rows: first row of the run, and its table."""
    norm = 10 + 90 * n * documents // max(words, 1)
    gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[row]))
    fan = np.diff(index.first)[term]
    # Rows go together until their cells or their postings are too many; one row always fits.
    load = np.bincount(row, weights=fan, minlength=len(n)) + max(index.n_items, 1)
    run = (np.cumsum(load) // CELLS).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(n)]
    cuts = np.searchsorted(row, edges)
    for a, b, low, high in zip(edges[:-1], edges[1:], cuts[:-1], cuts[1:]):
        if high == low:
            continue
        count = fan[low:high]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = index.items[np.repeat(index.first[term[low:high]], count) + inner]
        cell = np.repeat(row[low:high] - a, count) * index.n_items + item
        each = np.repeat(gain[low:high], count)
        size = (b - a) * index.n_items
        # Sums of doubles are exact below 2^53: two halves of each number, added apart.
        halves = [np.bincount(cell, weights=h, minlength=size) for h in (each >> 24, each & 0xFFFFFF)]
        total = (halves[0].astype(np.int64) << 24) + halves[1].astype(np.int64)
        yield a, total.reshape(b - a, index.n_items)


class _Heaps:
    """The best rows of each item so far: by score, equal ones by id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.kept: pa.Table | None = None
        self.least = np.ones(n_items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        least = self.least
        if len(scores) > 2 * self.top:
            cut = len(scores) - self.top
            least = np.maximum(least, np.partition(scores, cut, axis=0)[cut])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        found = pa.table(
            {"item": pa.array(item, pa.int32()), "score": pa.array(scores[row, item], pa.int64()), "id": ids.take(pa.array(row))}
        )
        both = found if self.kept is None else pa.concat_tables([self.kept, found])
        order = [("item", "ascending"), ("score", "descending"), ("id", "ascending")]
        both = both.sort_by(order).combine_chunks()
        item = both.column("item").to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.kept = both.filter(pa.array(place < self.top))
        full = np.flatnonzero(place == self.top - 1)
        self.least[item[full]] = both.column("score").to_numpy()[full]


def _best(docs: DataFrame, index, weights, documents: int, words: int, top: int) -> DataFrame:
    """The heaps of all tasks, merged: number of the item, score, id, rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, factors = index.value, weights.value
        heaps = _Heaps(postings.n_items, top)
        for batch in batches:
            for rows in byte_blocks(batch, "text", _TEXT_BYTES):
                for low, *counts in _counts(rows.column("text"), postings.terms):
                    for at, scores in score_rows(postings, factors, documents, words, *counts):
                        heaps.add(scores, rows.column("id").slice(low + at, len(scores)))
        if heaps.kept is not None:
            kept = heaps.kept
            number = pa.array(postings.numbers[kept.column("item").to_numpy()], pa.int64())
            group = pa.array(np.full(len(kept), TaskContext.get().partitionId() // FAN_IN), pa.int32())
            columns = [number, kept.column("score"), kept.column("id"), group]
            yield from pa.table(columns, names=["number", "score", "id", "part"]).to_batches()

    kind = dict(docs.dtypes)["id"]
    found = docs.mapInArrow(run, f"number bigint, score bigint, id {kind}, part int")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (["number", "part"], ["number"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return found.select("number", "score", "id", "rank")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` best rows of ``docs`` for each row of ``items``: item id, rank, id, score.

    Only scores above 0 count; equal scores rank by ascending id, null ids last, and ranks are unique
    from 1. An item without terms, or whose terms no document holds, has no rows. Null texts have no
    terms. Repeated rows of ``docs`` are ranked each; rows of ``items`` with one id are searched each.
    Ids may be of any ordered type, and other columns are ignored. Items beyond ``block_bytes`` are
    searched block by block, with two passes over the documents for each.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), utf8(text_column).alias("text"))
    numbered = materialize(
        items.select(
            F.col(f"`{item_column}`").alias("item_id"),
            utf8(item_text).alias("text"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "search-items",
    )
    size = numbered.agg(F.sum(F.length("text") + ITEM_BYTES)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    context = docs.sparkSession.sparkContext
    found = None
    for block in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        texts = own.select("number", "text").toArrow().sort_by("number").combine_chunks()
        index = Index.of(texts.column("text").combine_chunks(), texts.column("number").to_numpy())
        shared = [context.broadcast(index.terms), context.broadcast(index)]
        known = _statistics(rows, shared[0])
        documents, words = known.pop(-1, (0, 0))
        weights = np.zeros(len(index.terms), dtype=np.int64)
        for term, (held_by, _) in known.items():
            weights[term] = weight(documents, held_by)
        shared.append(context.broadcast(weights))
        best = _best(rows, shared[1], shared[2], documents, words, top)
        named = own.select("item_id", "number")
        best = best.join(named, "number").select(
            F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score"
        )
        if blocks > 1:
            best = materialize(best, "search-block")
            for one in shared:
                one.destroy()
        found = best if found is None else found.unionByName(best)
    return found
