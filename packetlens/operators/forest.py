"""Scoring with a forest of binary trees: a numpy helper for Arrow batches inside Spark tasks."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees as flat node arrays, one tree after the other, roots first.

    A row goes left where ``x[feature] <= threshold``. Leaves point to themselves, so that all rows
    of a batch walk a tree's full depth together. ``value`` holds one row of payload per node, and
    ``total`` sums the payloads of the leaves that a row reaches.
    """

    def __init__(self, roots, feature, threshold, left, right, value, depth):
        #: Plain arrays, to be broadcast: executors need not know this class to read them.
        self.parts = {
            "roots": np.asarray(roots, dtype=np.int64),
            "feature": np.asarray(feature, dtype=np.int64),
            "threshold": np.asarray(threshold, dtype=np.float64),
            "left": np.asarray(left, dtype=np.int64),
            "right": np.asarray(right, dtype=np.int64),
            "value": np.asarray(value, dtype=np.float64),
            "depth": np.asarray(depth, dtype=np.int64),
        }
        # In the order of places the two children of a node are neighbours, right before left.
        left, right = self.parts["left"], self.parts["right"]
        self.roots = self.parts["roots"]
        inner = np.flatnonzero(left >= 0)
        place = np.full(len(left), -1)
        place[self.roots] = np.arange(len(self.roots))
        place[right[inner]] = len(self.roots) + 2 * np.arange(len(inner))
        place[left[inner]] = place[right[inner]] + 1
        order = np.argsort(place)
        leaf = left[order] < 0
        self.child = np.where(leaf, np.arange(len(order)), place[right[order]])
        self.feature = np.where(leaf, 0, self.parts["feature"][order])
        # Nothing is below NaN, so that a row stays in its leaf.
        self.threshold = np.where(leaf, np.nan, self.parts["threshold"][order])
        self.value = self.parts["value"][order]
        self.levels = np.maximum.reduceat(self.parts["depth"], self.roots)

    def total(self, rows: np.ndarray) -> np.ndarray:
        """Sum of leaf payloads per row; equal rows of the batch walk the trees once."""
        if not len(rows):
            return np.zeros((0, self.value.shape[1]))
        rows, back = np.unique(rows + 0.0, axis=0, return_inverse=True)
        flat = np.ascontiguousarray(rows).ravel()
        n = len(rows)
        start = np.arange(n) * rows.shape[1]
        result = np.zeros((n, self.value.shape[1]))
        # The same arrays for every level: a walk is a few passes over the batch, and new ones would cost more.
        at, node, below = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n, bool)
        x, bound = np.empty(n), np.empty(n)
        for place, levels in enumerate(self.levels):
            node.fill(place)
            for _ in range(levels):
                self.feature.take(node, out=at, mode="clip")
                at += start
                flat.take(at, out=x, mode="clip")
                self.threshold.take(node, out=bound, mode="clip")
                np.less_equal(x, bound, out=below)
                self.child.take(node, out=at, mode="clip")
                np.add(at, below, out=node)
            result += self.value.take(node, axis=0)
        return result[back.reshape(-1)]
