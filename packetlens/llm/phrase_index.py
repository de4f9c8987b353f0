"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of blocks. A block holds some documents' words as posting lists: for each term
its positions in the block, ascending. Documents are never split between blocks, so lists of terms
are intersected within a row and searching shuffles nothing. Terms are 64-bit hashes of words.

A phrase is searched from its rarest term on: the term's list, less the term's place in the phrase,
is the list of possible starts; it is intersected with the other terms' lists, less their places,
rarest first. What is left after all terms are exact occurrences. Rarity is counted over all blocks.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower case A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .frames import map_arrow, utf8
from .words import ALPHANUMERIC, hashed_words, text_blocks

WINDOW = 10

# A block of test items is broadcast; larger sets of items are searched block by block.
ITEM_BYTES = 8_000_000
# The index is restricted to the items' terms if they are no more than this (8 bytes each).
MAX_TERMS = 4_000_000

INDEX_SCHEMA = (
    "ids array<bigint>, words array<int>, terms array<bigint>, counts array<int>, positions binary"
)
FOUND_SCHEMA = (
    "block bigint, place int, id bigint, n_words bigint, "
    "spans array<struct<start:bigint,stop:bigint>>, items array<string>"
)


@dataclass
class Items:
    """Test items as terms: ``words`` are places in ``terms``, ``counts`` the terms' occurrences."""

    ids: list[str]
    first: np.ndarray
    words: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def build_index(
    docs: DataFrame, id_column: str, text_column: str, terms: np.ndarray | None = None
) -> DataFrame:
    """Write the index of all words, or of those in the sorted ``terms`` only."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            ids = batch.column(0)
            for start, end, block, offsets in text_blocks(batch.column(1)):
                words, first = hashed_words(block, offsets, ALPHANUMERIC)
                position = np.arange(len(words), dtype=np.int32)
                if wanted is not None:
                    place = np.searchsorted(wanted, words)
                    known = np.append(wanted, np.uint64(0))[place] == words
                    known &= place < len(wanted)
                    words, position = words[known], position[known]
                order = np.argsort(words, kind="stable")
                found, counts = np.unique(words[order], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.array([ids[start:end].to_pylist()], pa.list_(pa.int64())),
                        "words": pa.array([np.diff(first)], pa.list_(pa.int32())),
                        "terms": pa.array([found.view(np.int64)], pa.list_(pa.int64())),
                        "counts": pa.array([counts], pa.list_(pa.int32())),
                        "positions": pa.array([position[order].tobytes()], pa.binary()),
                    }
                )

    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), utf8(text_column))
    blocks = map_arrow(texts, build, INDEX_SCHEMA)
    return materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "index")


def term_counts(index: DataFrame) -> DataFrame:
    """``(term, occurrences)`` over all blocks."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.terms").alias("term")).agg(
        F.sum(F.col("x.counts").cast("bigint")).alias("occurrences")
    )


def _item_blocks(items: DataFrame, id_column: str, text_column: str) -> list[DataFrame]:
    """Items in blocks of bounded size; one item is never split."""
    named = items.select(
        F.col(f"`{id_column}`").cast("string").alias("item"), utf8(text_column).alias("text")
    )
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    if n <= 1:
        return [named]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [named.filter(part == i) for i in range(n)]


def _read_items(block: DataFrame) -> Items:
    rows = block.toArrow()
    ids, parts, first = [], [], [0]
    for start, end, text, offsets in text_blocks(rows.column("text").combine_chunks()):
        words, at = hashed_words(text, offsets, ALPHANUMERIC)
        parts.append(words)
        first += [int(n) + first[start] for n in at[1:]]
    words = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)])
    terms, place = np.unique(words, return_inverse=True)
    ids = rows.column("item").to_pylist()
    return Items(ids, np.array(first), place, terms, np.zeros(len(terms), dtype=np.int64))


def _with_counts(spark: SparkSession, items: Items, counts: DataFrame) -> Items:
    if len(items.terms):
        terms = spark.createDataFrame(pd.DataFrame({"term": items.terms.view(np.int64)}))
        known = counts.join(F.broadcast(terms), "term").toPandas()
        at = np.searchsorted(items.terms, known["term"].to_numpy(dtype=np.int64).view(np.uint64))
        items.counts[at] = known["occurrences"].to_numpy()
    return items


@dataclass
class _Windows:
    """Windows of items, their terms rarest first: ``term[:, k]`` stands ``offset[:, k]`` from the start."""

    item: np.ndarray
    length: np.ndarray
    term: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, items: Items, size: int) -> _Windows:
        count = np.diff(items.first)
        runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(count)), runs)
        begin = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = begin + items.first[:-1][item]
        length = np.minimum(count[item], size)
        offset = np.broadcast_to(np.arange(size), (len(item), size))
        inside = offset < length[:, None]
        if not len(items.words):
            none = np.zeros((0, size), dtype=np.int64)
            return cls(item, length, none, none)
        term = items.words[np.minimum(begin[:, None] + offset, len(items.words) - 1)]
        rarity = np.where(inside, items.counts[term], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")
        return cls(
            item, length, np.take_along_axis(term, order, 1), np.take_along_axis(offset, order, 1)
        )


class _Block:
    """A block's posting lists, with terms as places in the items' terms."""

    def __init__(self, row: dict, terms: np.ndarray):
        self.ids = row["ids"]
        self.words = np.array(row["words"], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.words)])
        own = np.array(row["terms"], dtype=np.int64).view(np.uint64)
        counts = np.array(row["counts"], dtype=np.int64)
        position = np.frombuffer(row["positions"], dtype=np.int32).astype(np.int64)
        place = np.searchsorted(terms, own)
        known = place < len(terms)
        known[known] = terms[place[known]] == own[known]
        keep = np.repeat(known, counts)
        self.position = position[keep]
        self.length = np.zeros(len(terms), dtype=np.int64)
        self.length[place[known]] = counts[known]
        self.start = np.cumsum(self.length) - self.length
        self.keys = (np.repeat(place[known], counts[known]) << 32) | self.position

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether ``term`` stands at ``position``."""
        wanted = (term << 32) | position
        at = np.searchsorted(self.keys, wanted)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == wanted[found]
        return found

    def occurrences(self, windows: _Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions at which they occur within one document."""
        if not len(windows.item) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        width = windows.term.shape[1]
        needed = np.arange(width) < windows.length[:, None]
        possible = np.flatnonzero(((self.length[windows.term] > 0) | ~needed).all(axis=1))
        rarest = windows.term[possible, 0]
        n = self.length[rarest]
        window = np.repeat(possible, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.position[np.repeat(self.start[rarest], n) + inner]
        at = at - windows.offset[window, 0]
        keep = at >= 0
        window, at = window[keep], at[keep]
        for k in range(1, width):
            if not len(window):
                break
            there = self.has(windows.term[window, k], at + windows.offset[window, k])
            keep = there | (windows.length[window] <= k)
            window, at = window[keep], at[keep]
        end = at + windows.length[window] - 1
        same = self.document(at) == self.document(end)
        return window[same], at[same]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def _exact_hits(block: _Block, windows: _Windows, items: Items) -> Iterator[dict]:
    window, at = block.occurrences(windows)
    change = np.zeros(int(block.first[-1]) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.length[window], -1)
    covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    covered_from = np.flatnonzero(np.diff(covered.astype(np.int8)) == 1)
    covered_to = np.flatnonzero(np.diff(covered.astype(np.int8)) == -1)
    owner = block.document(at)
    pairs = np.unique(np.stack([owner, windows.item[window]]), axis=1)
    for place, (identity, n) in enumerate(zip(block.ids, block.words)):
        low, high = block.first[place], block.first[place + 1]
        # A covered run may touch the next document's, so it is cut at the border.
        a = np.searchsorted(covered_to, low, side="right")
        b = np.searchsorted(covered_from, high)
        spans = [
            {"start": int(max(s, low) - low), "stop": int(min(e, high) - low)}
            for s, e in zip(covered_from[a:b], covered_to[a:b])
        ]
        i, j = np.searchsorted(pairs[0], [place, place + 1])
        names = [items.ids[k] for k in pairs[1, i:j]]
        yield {"place": place, "id": identity, "n_words": int(n), "spans": spans, "items": names}


def _search(index: DataFrame, items: Items, size: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        windows = _Windows.of(items, size)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                block = _Block(row, items.terms)
                found = [{"block": row["block"], **x} for x in _exact_hits(block, windows, items)]
                yield pa.RecordBatch.from_pylist(found, schema=_FOUND)

    return map_arrow(index, search, FOUND_SCHEMA)


_FOUND = pa.schema(
    [
        ("block", pa.int64()),
        ("place", pa.int32()),
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _covered(spans: str):
    """Number of places in the union of spans that may overlap."""
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("stop"))

    def step(state, span):
        begin = F.greatest(state["stop"], span["start"])
        stop = F.greatest(state["stop"], span["stop"])
        grown = state["n"] + F.greatest(F.lit(0).cast("bigint"), span["stop"] - begin)
        return F.struct(grown.alias("n"), stop.alias("stop"))

    return F.aggregate(F.array_sort(spans), none, step, lambda state: state["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (array, sorted, of distinct ids), spans.

    A window is ``size`` consecutive words of an item, or all words of a shorter one. Every word of
    a document inside an occurrence of a window is hit; ``spans`` are the runs of such words. Null
    and empty texts have no words; items without words have no window; a null item id is left out of
    ``items`` but its windows count. Repeated documents get a row each, repeated items count once.
    Only the named columns are read.
    """
    spark = docs.sparkSession
    blocks = [_read_items(b) for b in _item_blocks(items, item_id, item_text)]
    terms = np.unique(np.concatenate([b.terms for b in blocks]))
    index = build_index(docs, id_column, text_column, terms if len(terms) <= MAX_TERMS else None)
    counts = term_counts(index)
    found = [_search(index, _with_counts(spark, b, counts), size) for b in blocks]
    merged = found[0]
    if len(found) > 1:
        for more in found[1:]:
            merged = merged.unionByName(more)
        merged = merged.groupBy("block", "place").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
    names = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    return merged.select(
        F.col("id").alias(id_column),
        "n_words",
        _covered("spans").alias("n_hit"),
        names.alias("items"),
        "spans",
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    **options,
) -> DataFrame:
    """The rows of ``docs`` without a window of an item, with all their columns.

    Rows are told apart by a 64-bit hash of id and text, so those without an id are too.
    """
    key = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    keyed = docs.select(key.alias("key"), F.col(f"`{text_column}`").alias("text"))
    found = contamination(keyed, items, "key", "text", **options)
    hit = found.filter("n_hit > 0").select("key").distinct()
    return docs.join(hit, key == hit["key"], "left_anti")


def proximity(
    index: DataFrame, items: DataFrame, within: int, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(id, item, start)``: runs of ``within`` words of a document that hold all words of an item.

    Order doesn't matter and a repeated word of an item needs to stand there once. ``start`` is the
    place of the run's first word; of runs that hold the same occurrence of the item's rarest word,
    the last counts. Items without words match nothing.
    """
    spark, counts = index.sparkSession, term_counts(index)
    result = None
    for part in _item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(_with_counts(spark, _read_items(part), counts))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    found = list(_near(_Block(row, items.terms), items, within))
                    columns = list(zip(*found)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(columns[0], pa.int64()),
                            pa.array(columns[1], pa.string()),
                            pa.array(columns[2], pa.int64()),
                        ],
                        names=["id", "item", "start"],
                    )

        found = map_arrow(index, search, "id bigint, item string, start bigint")
        result = found if result is None else result.unionByName(found)
    return result


def _near(block: _Block, items: Items, within: int) -> Iterator[tuple]:
    for k, name in enumerate(items.ids):
        terms = np.unique(items.words[items.first[k] : items.first[k + 1]])
        if not len(terms) or not block.length[terms].all():
            continue
        lists = [
            block.position[block.start[t] : block.start[t] + block.length[t]]
            for t in terms[np.argsort(items.counts[terms], kind="stable")]
        ]
        place = block.document(lists[0])
        low, high = block.first[place], block.first[place + 1]
        starts = lists[0][:, None] - np.arange(within)
        good = starts >= low[:, None]
        for positions in lists[1:]:
            at = np.searchsorted(positions, np.maximum(starts, low[:, None]))
            next_one = np.append(positions, np.iinfo(np.int64).max)[at]
            good &= next_one <= np.minimum(starts + within, high[:, None]) - 1
        for row in np.flatnonzero(good.any(axis=1)):
            start = int(starts[row, good[row].argmax()] - low[row])
            yield block.ids[place[row]], name, start
