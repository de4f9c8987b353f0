"""Random forests fitted on counts of rows that trees can't tell apart.

A tree sees of a row the bins of its features and its label. Rows that agree in these are one cell, and
the Poisson(1) weights that a bootstrap gives each of ``n`` rows sum to a Poisson(n). So trees grown on
cells follow the same law as trees grown on all rows, while a cell is drawn once a tree. The cells are
sent to every task, and each tree is grown by one. A table of too many cells isn't fitted here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import materialize

# More bytes of cells are not collected and sent to all tasks.
CELL_BYTES = 32_000_000
# Sums that a task holds for the nodes which it splits together.
HISTOGRAM = 1 << 21
# Accuracy of the quantiles at which features of many values are cut.
ACCURACY = 10_000

NODE_SCHEMA = (
    "tree int, id int, prediction double, impurity double, stats array<double>, n bigint, gain double, "
    "left int, right int, feature int, threshold array<double>"
)


@dataclass
class Cells:
    """``n`` rows of each combination of bins and label; bin ``b`` of a feature ends at its cut ``b``."""

    bins: np.ndarray
    label: np.ndarray
    n: np.ndarray
    cuts: list[np.ndarray]


def cut_points(df: DataFrame, names: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """For each column the values at or below which rows can go left, from all rows.

    All places between values where a column has ``max_bins`` at most, else quantiles.
    """
    few = _few_values(df, names, max_bins)
    many = [i for i, values in enumerate(few) if values is None]
    bad = [F.count_if(F.col(n).isNull() | F.isnan(n)).alias(f"bad{i}") for i, n in enumerate(names)]
    shares = [i / max_bins for i in range(1, max_bins)]
    quantiles = [F.percentile_approx(names[i], shares, ACCURACY).alias(f"cuts{i}") for i in many]
    found = df.agg(*bad, *quantiles).first()
    if wrong := [n for i, n in enumerate(names) if found[f"bad{i}"]]:
        raise ValueError(f"Null or NaN in feature columns: {wrong}")
    return [
        np.unique(found[f"cuts{i}"]) if values is None else _between(np.array(sorted(values)))
        for i, values in enumerate(few)
    ]


def _between(values: np.ndarray) -> np.ndarray:
    low, high = values[:-1], values[1:]
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (low + high) / 2
    return np.where(np.isfinite(middle) & (low <= middle) & (middle < high), middle, low)


def _few_values(df: DataFrame, names: Sequence[str], most: int) -> list[set[float] | None]:
    """The distinct values of each column; None where there are more than ``most``."""
    width = len(names)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[set | None] = [set() for _ in range(width)]
        for batch in batches:
            for i, values in enumerate(found):
                if values is not None:
                    values.update(pc.unique(batch.column(i)).to_pylist())
                    if len(values) > most:
                        found[i] = None
        # A null stands for too many; those of the rows are an error in any case.
        rows = [(i, x) for i, values in enumerate(found) for x in ([None] if values is None else values)]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "x"])

    few: list[set[float] | None] = [set() for _ in names]
    values = df.select(*names).mapInArrow(distinct, "i int, x double").distinct()
    many = F.count_if(F.col("x").isNull()).alias("more")
    for row in values.groupBy("i").agg(F.collect_list("x").alias("x"), many).collect():
        few[row.i] = None if row.more or len(row.x) > most else set(row.x)
    return few


def count_cells(df: DataFrame, names: Sequence[str], label: str, max_bins: int) -> Cells | None:
    """The cells of all rows, ordered; None if they are more than ``CELL_BYTES``.

    ``label`` numbers the classes from 0. A null or NaN feature is an error.
    """
    cuts = cut_points(df, names, max_bins)
    width = len(names) + 2

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.empty((batch.num_rows, width), dtype=np.uint8)
            for i, cut in enumerate(cuts):
                key[:, i] = np.searchsorted(cut, batch.column(i).to_numpy(zero_copy_only=False))
            classes = batch.column(width - 2).to_numpy(zero_copy_only=False).astype(">u2")
            key[:, -2:] = classes.view(np.uint8).reshape(-1, 2)
            ends = np.arange(0, key.size + 1, width, dtype=np.int32)
            keys = pa.Array.from_buffers(
                pa.binary(), len(key), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(key.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([keys], names=["key"])

    keys = df.select(*names, F.col(label).cast("double")).mapInArrow(binned, "key binary")
    counted = materialize(keys.groupBy("key").agg(F.count("*").alias("n")), "cells")
    if counted.count() * (width + 8) > CELL_BYTES:
        return None
    table = counted.toArrow()
    # The keys are of one length, so the bytes of a chunk are a table.
    chunks = [c for c in table["key"].chunks if len(c)]
    key = np.concatenate([_bytes(c, width) for c in chunks])
    key = key.reshape(-1, width)
    order = np.lexsort(key.T[::-1])
    key = key[order]
    classes = key[:, -2].astype(np.int64) * 256 + key[:, -1]
    return Cells(np.ascontiguousarray(key[:, :-2]), classes, table["n"].to_numpy()[order], cuts)


def _bytes(keys: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(keys.buffers()[2], np.uint8, len(keys) * width, keys.offset * width)


def grow_tree(
    bins: np.ndarray,
    label: np.ndarray,
    weight: np.ndarray,
    widths: Sequence[int],
    classes: int,
    max_depth: int,
    rng: np.random.Generator,
) -> dict[str, np.ndarray]:
    """Nodes of one tree, children after their parents; ``cut`` is the last bin that goes left.

    As Spark ML grows trees: a node is split at the place of most gain in Gini impurity among those of
    some features, as many as the root of their number, drawn for the node; it is a leaf if none gains.
    Two leaves of one node that predict the same class are one.
    """
    features = bins.shape[1]
    tried = math.ceil(math.sqrt(features))
    together = max(1, HISTOGRAM // (max(widths) * classes))
    stats = [np.bincount(label, weights=weight, minlength=classes)[None, :]]
    inner: list[tuple[np.ndarray, ...]] = []  # ids, features, cuts, gains, ids of left children
    count = 1
    start = np.flatnonzero(weight)
    todo = [(start, np.zeros(len(start), dtype=np.int64), np.zeros(1, dtype=np.int64), stats[0], 0)]
    if max_depth < 1 or np.count_nonzero(stats[0]) < 2:
        todo = []
    while todo:
        rows, node, ids, total, depth = todo.pop()
        size = total.sum(axis=1)
        before = (total**2).sum(axis=1) / size
        drawn = np.zeros((len(ids), features), dtype=bool)
        np.put_along_axis(drawn, rng.random((len(ids), features)).argsort(axis=1)[:, :tried], True, axis=1)
        best, where, cut = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        goes_left = np.zeros((len(ids), classes))
        for f in range(features):
            asked = np.flatnonzero(drawn[:, f])
            if widths[f] < 2 or not len(asked):
                continue
            place = np.full(len(ids), -1)
            place[asked] = np.arange(len(asked))
            at = place[node]
            some = np.flatnonzero(at >= 0)
            of = rows[some]
            code = (at[some] * widths[f] + bins[of, f]) * classes + label[of]
            sums = np.bincount(code, weights=weight[of], minlength=len(asked) * widths[f] * classes)
            below = sums.reshape(len(asked), widths[f], classes).cumsum(axis=1)[:, :-1]
            above = total[asked][:, None, :] - below
            low, high = below.sum(axis=2), above.sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (below**2).sum(axis=2) / low + (above**2).sum(axis=2) / high
            score = np.where((low > 0) & (high > 0), score - before[asked][:, None], -np.inf)
            k = score.argmax(axis=1)
            score = score[np.arange(len(asked)), k]
            more = score > best[asked]
            won = asked[more]
            best[won], where[won], cut[won] = score[more], f, k[more]
            goes_left[won] = below[more, k[more]]
        split = best > 1e-14 * size  # what is less may be the rounding of zero
        parents = np.flatnonzero(split)
        if not len(parents):
            continue
        born = np.stack([goes_left[parents], total[parents] - goes_left[parents]], axis=1).reshape(-1, classes)
        first_child = count + 2 * np.arange(len(parents))
        inner.append((ids[parents], where[parents], cut[parents], (best / size)[parents], first_child))
        stats.append(born)
        going = ((born > 0).sum(axis=1) > 1) & (depth + 1 < max_depth)
        rank = np.cumsum(split) - 1
        rows, node = rows[split[node]], node[split[node]]
        child = 2 * rank[node] + (bins[rows, where[node]] > cut[node])
        rows, child = rows[going[child]], child[going[child]]
        kept = np.flatnonzero(going)
        order = np.argsort(child, kind="stable") if len(kept) > together else slice(None)
        rows, child = rows[order], (np.cumsum(going) - 1)[child[order]]
        for first in range(0, len(kept), together):
            group = kept[first : first + together]
            part = slice(None)
            if len(kept) > together:
                part = slice(*np.searchsorted(child, [first, first + len(group)]))
            todo.append((rows[part], child[part] - first, count + group, born[group], depth + 1))
        count += len(born)
    return _pruned(np.concatenate(stats), inner)


def _pruned(stats: np.ndarray, inner: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """Node arrays with leaves of the same class and the same parent put together, numbered anew."""
    n = len(stats)
    feature, cut, gain, left = np.full(n, -1), np.full(n, -1), np.full(n, -1.0), np.full(n, -1)
    for ids, *values in inner:
        for column, value in zip((feature, cut, gain, left), values):
            column[ids] = value
    prediction = stats.argmax(axis=1)
    for i in np.flatnonzero(left >= 0)[::-1]:
        a = left[i]
        if left[a] < 0 and left[a + 1] < 0 and prediction[a] == prediction[a + 1]:
            left[i] = -1
    alive = np.zeros(n, dtype=bool)
    alive[0] = True
    for i in np.flatnonzero(left >= 0):
        alive[left[i]] = alive[left[i] + 1] = alive[i]
    number = np.cumsum(alive) - 1
    leaf = left < 0
    nodes = {
        "id": number,
        "prediction": prediction,
        "stats": stats,
        "gain": np.where(leaf, -1.0, gain),
        "left": np.where(leaf, -1, number[left]),
        "right": np.where(leaf, -1, number[np.minimum(left + 1, n - 1)]),
        "feature": np.where(leaf, -1, feature),
        "cut": np.where(leaf, -1, cut),
    }
    return {name: column[alive] for name, column in nodes.items()}


def grow_forest(
    spark: SparkSession, cells: Cells, classes: int, trees: int, max_depth: int, seed: int
) -> DataFrame:
    """Nodes of all trees, as ``NODE_SCHEMA``."""
    shared = spark.sparkContext.broadcast((cells.bins, cells.label, cells.n, cells.cuts))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, label, n, cuts = shared.value
        widths = [len(cut) + 1 for cut in cuts]
        for tree in (int(t) for batch in batches for t in batch["id"]):
            rng = np.random.default_rng([seed, tree])
            weight = rng.poisson(n).astype(np.float64)
            nodes = grow_tree(bins, label, weight, widths, classes, max_depth, rng)
            size = nodes["stats"].sum(axis=1)
            shares = nodes["stats"] / np.maximum(size, 1)[:, None]
            yield pd.DataFrame(
                {
                    "tree": tree,
                    "id": nodes["id"],
                    "prediction": nodes["prediction"].astype(np.float64),
                    "impurity": 1 - (shares**2).sum(axis=1),
                    "stats": list(nodes["stats"]),
                    "n": size.astype(np.int64),
                    "gain": nodes["gain"],
                    "left": nodes["left"],
                    "right": nodes["right"],
                    "feature": nodes["feature"],
                    "threshold": [
                        [] if f < 0 else [float(cuts[f][c])] for f, c in zip(nodes["feature"], nodes["cut"])
                    ],
                }
            )

    parts = min(trees, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, trees, 1, parts).mapInPandas(grow, NODE_SCHEMA)
