"""Near-duplicate documents: MinHash with banding, verification on full sets, components.

A document's set is its distinct runs of five words. Documents are linked when their sets' Jaccard
similarity reaches a threshold; linked documents, directly or through others, form a component.

1. One pass over the texts gives each document the size and a 128-bit digest of its set, and the
   bands of its MinHash signature: minima of many universal hashes, five to a band.
2. Documents of equal sets are one class, whatever their number; one of them stands for all.
3. Classes that share a band are joined to the band's least member. Components of these links are
   families: only members of one family can be linked.
4. A family is dealt in blocks of bounded size, and each pair of blocks is one group. In a group,
   signatures pick the likely pairs and the full sets decide; a group returns no more links than it
   has members, because only who is connected matters. No list of all pairs is made.
5. Components of these links, by large-star and small-star.

A pair at exactly the threshold is missed with probability (1 - t**5)**50, about 1e-6 for t = 0.75,
unless other pairs bring the two into one family; likelier pairs are practically never missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .components import components
from .frames import map_arrow, unused, utf8
from .words import SPACED, hashed_words, mix, shingles, text_blocks

SHINGLE = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 50, 5
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1_000_000
_CHUNK = 1024
_COLUMNS = 4096


def _universal_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of x -> a x + b modulo 2**32, fixed for all tasks."""
    numbers = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    factors, summands = (numbers >> np.uint64(32)).astype(np.uint32).reshape(2, -1)
    return factors | np.uint32(1), summands


def signature(found: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a set that isn't empty."""
    factors, summands = _universal_hashes()
    keys = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.uint32(0xFFFFFFFF))
    for at in range(0, len(keys), _CHUNK):
        part = factors[:, None] * keys[None, at : at + _CHUNK] + summands[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for row in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return key


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for first, end, block, offsets in text_blocks(texts):
        words, at = hashed_words(block, offsets, SPACED)
        runs, at = shingles(words, at, size)
        for i in range(end - first):
            yield np.unique(runs[at[i] : at[i + 1]])


def _mark(size: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), size))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = _bands(np.stack([signature(sets[i]) for i in full])) if full else None
            bands = [None] * len(sets)
            for row, i in enumerate(full):
                bands[i] = keys[row].view(np.int64)
            digests = np.zeros((2, len(sets)), dtype=np.uint64)
            for i, s in enumerate(sets):
                digests[0, i] = mix(s).sum()
                digests[1, i] = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[0].view(np.int64)),
                    pa.array(digests[1].view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "n", "d1", "d2", "bands"],
            )

    return mark


def _member_sets(size: int):
    def member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _sets(batch.column("text"), size)]
            rest = [batch.column(n) for n in ("root", "node", "blocks")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(sets, pa.binary())], names=["root", "node", "blocks", "shingles"]
            )

    return member_sets


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices."""
    both = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    _, column, count = np.unique(both, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    width = int(shared.sum())
    for start in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        ones = np.zeros((len(left) + len(right), min(_COLUMNS, width - start)), dtype=np.float32)
        ones[row[a:b], column[a:b] - start] = 1
        total += np.rint(ones[: len(left)] @ ones[len(left) :].T).astype(np.int64)
    return total


def likely(left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs whose signatures agree as often as similar sets' do, with six standard deviations."""
    t, k = threshold / 100, BANDS * ROWS
    bound = k * t - 6 * np.sqrt(k * t * (1 - t))
    return np.stack([(right == one).sum(axis=1) >= bound for one in left])


def _connected(sets: list[np.ndarray], inside: np.ndarray, threshold: int) -> np.ndarray:
    """For each set the least set it is connected with; ``inside`` marks the block of each."""
    left = np.flatnonzero(~inside)
    right = np.flatnonzero(inside)
    label = np.arange(len(sets))
    # The lower block has no members: the other's own group decides on its pairs.
    if not len(left):
        return label
    if not len(right):
        right = left
    signatures = np.stack([signature(s) for s in sets])
    pairs = likely(signatures[left], signatures[right], threshold)
    rows, columns = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
    if not len(rows):
        return label
    size = np.array([len(s) for s in sets])
    common = _overlaps([sets[i] for i in left[rows]], [sets[i] for i in right[columns]])
    union = size[left[rows]][:, None] + size[right[columns]][None, :] - common
    linked = pairs[np.ix_(rows, columns)] & (100 * common >= threshold * union)
    near = np.zeros((len(sets), len(sets)), dtype=bool)
    near[np.ix_(left[rows], right[columns])] = linked
    near |= near.T
    np.fill_diagonal(near, True)
    while True:
        lower = np.where(near, label[None, :], len(sets)).min(axis=1)
        if (lower == label).all():
            return label
        label = lower


def _links(threshold: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["inside", "node"], ignore_index=True)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
        label = _connected(sets, group["inside"].to_numpy(dtype=bool), threshold)
        node = group["node"].to_numpy()
        moved = node != node[label]
        return pd.DataFrame({"a": node[moved], "b": node[label][moved]})

    return links


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: int = THRESHOLD,
    size: int = SHINGLE,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z in lower case. A text of fewer than ``size`` words has
    one shingle, its whole sequence; null and empty texts have none and are linked with nothing.
    ``component_id`` is the least id reachable over links, and ``kept`` says that it is the row's
    own. A row without an id is in no component (null) and kept. Rows that share an id are one
    document of several texts: all get the same component, and all are kept if it is theirs.
    Other columns of ``docs`` are not read, so their names don't matter.
    """
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), utf8(text_column))
    marks = materialize(
        map_arrow(texts, _mark(size), "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"),
        "minhash",
    )
    named = marks.filter("n > 0 and id is not null")
    classes = named.groupBy("d1", "d2", "n").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands")
    )
    keys = classes.select("rep", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("members"))
    near = keys.join(heads.filter("members > 1"), "key").filter("rep <> head")
    families = components(near.select(F.col("rep").alias("a"), F.col("head").alias("b")))

    weights = families.join(
        named.groupBy(F.col("id").alias("node")).agg(F.max("n").alias("n")), "node"
    )
    blocks = F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)
    sizes = weights.groupBy("root").agg(F.ceil(blocks).cast("int").alias("blocks"))
    members = materialize(families.join(sizes, "root"), "families")
    member_texts = texts.toDF("node", "text").join(members, "node")
    sets = map_arrow(
        member_texts.select("root", "node", "blocks", "text"),
        _member_sets(size),
        "root bigint, node bigint, blocks int, shingles binary",
    ).filter(F.length("shingles") > 0)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        sets.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "root",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).alias("inside"),
            "node",
            "shingles",
        )
    )
    links = dealt.groupBy("root", "i", "j").applyInPandas(_links(threshold), "a bigint, b bigint")
    same_id = named.join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select(
        F.col("id").alias("a"), F.col("rep").alias("b")
    )
    repeated = _of_several_texts(named).join(same_id.withColumnRenamed("a", "id"), "id")
    found = components(
        links.unionByName(repeated.select(F.col("id").alias("a"), "b"))
    )
    placed = (
        marks.select("id", "n", "d1", "d2")
        .join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return placed.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (component.isNull() | (component == F.col("id"))).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """One row of each component, that of the least id, with all its columns.

    Here a document is an id with a text: texts that share an id are documents of their own, which go
    only if their own text has a near duplicate; of equal ids in a component the least md5 of the text
    stays. Of rows equal in both, the one that is least as JSON stays. Rows without an id stay. A null
    text counts as empty. Ids are numbers.
    """
    key = unused(docs.columns, "_document")
    identity, text = F.col(f"`{id_column}`").cast("bigint"), F.md5(utf8(text_column))
    seen = docs.select(identity.alias("id"), text.alias("md5")).filter("id is not null")
    several = seen.groupBy("id").agg(F.min("md5").alias("low"), F.max("md5").alias("high"))
    several = materialize(several.filter("low <> high").select("id"), "shared-ids")
    if several.isEmpty():
        keyed, numbered = docs.withColumn(key, identity), None
    else:
        # Numbers below all ids, written before they are used, so that a recomputed task agrees.
        lowest = seen.agg(F.least(F.min("id"), F.lit(0))).first()[0]
        pairs = seen.join(several, "id", "left_semi").distinct()
        number = (F.lit(lowest - 1) - F.monotonically_increasing_id()).alias("number")
        numbered = materialize(pairs.select("id", "md5", number), "shared-id-texts")
        rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(identity.alias("id"), text.alias("md5")).alias(key))
        own = (F.col(f"{key}.id") == numbered["id"]) & (F.col(f"{key}.md5") == numbered["md5"])
        keyed = rows.join(numbered, own, "left").select(
            *[rows[f"`{c}`"] for c in docs.columns],
            F.coalesce(numbered["number"], rows[key]["id"]).alias(key),
        )
    found = near_duplicates(keyed, key, text_column, **options)
    found = materialize(found.select(F.col(key).alias("id"), "component_id", "kept"), "kept")
    gone = found.filter("not kept").select("id").distinct()
    if numbered is not None:
        real = found.filter("id is not null").join(
            numbered.select(F.col("number").alias("id"), F.col("id").alias("real"), "md5"), "id", "left"
        )
        rank = F.struct(F.coalesce("real", "id"), F.coalesce("md5", F.lit("")), "id")
        first = real.groupBy("component_id").agg(F.min_by("id", rank).alias("first"))
        gone = real.join(first, "component_id").filter("id <> first").select("id").distinct()
    again = found.filter("id is not null").groupBy("id").count().filter("count > 1")
    again = materialize(again.join(gone, "id", "left_anti").select("id"), "repeated")
    document = F.col(key)
    rows = keyed.join(gone, document == gone["id"], "left_anti")
    if again.isEmpty():
        return rows.drop(key)
    once = rows.join(again, document == again["id"], "left_anti").drop(key)
    many = rows.join(again, document == again["id"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = many.groupBy(document.alias("id")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(one.select("row.*"))


def _of_several_texts(named: DataFrame) -> DataFrame:
    """Ids that occur with more than one set."""
    seen = named.groupBy("id").agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
    return seen.filter("low <> high").select("id")
