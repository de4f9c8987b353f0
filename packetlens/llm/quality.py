"""Quality of documents by attention-based multiple-instance learning.

Only documents have labels, but what spoils one may be a few of its passages. A document is a bag of
passages of ``PASSAGE`` words. Each passage is encoded from its bytes and words; a hidden layer makes
it a vector; gated attention gives every vector a weight, and the document's score is the logistic
function of the weighted mean. All weights are learned from the documents' labels together.

Fitting takes at most ``SAMPLE`` labelled documents, those of least hash. Scoring encodes every
passage of every text, in numpy within Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_arrow, unused, utf8
from .words import SPACED, byte_set, span_hashes, text_blocks, word_spans

SAMPLE = 6000  # labelled documents that the model is fitted on, at most
PASSAGE = 128  # words
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 3e-3, 1e-4
THRESHOLD = 0.3
_HASHED = 16

_UPPER = byte_set(lambda b: 65 <= b <= 90)
_DIGIT = byte_set(lambda b: 48 <= b <= 57)
_PUNCTUATION = byte_set(lambda b: 33 <= b <= 126 and not chr(b).isalnum())
_BEYOND = byte_set(lambda b: b >= 128)
_LETTER = byte_set(lambda b: chr(b).isalpha() if b < 128 else True)
_MARKS = np.cumsum(_PUNCTUATION) - 1  # a number for each punctuation mark
_N_MARKS = int(_PUNCTUATION.sum())
FEATURES = 13 + _N_MARKS + _HASHED


def encode(block: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage of a block of texts, and each text's first passage with the end last.

    A text without words has one passage of zeros.
    """
    data = np.frombuffer(block, dtype=np.uint8)
    start, end = word_spans(data, SPACED)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    bags = np.concatenate([[0], np.cumsum(np.maximum(-(-count // PASSAGE), 1))])
    out = np.zeros((int(bags[-1]), FEATURES), dtype=np.float32)
    if not len(start):
        return out, bags
    text = np.repeat(np.arange(len(count)), count)
    passage = bags[text] + (np.arange(len(start)) - first[text]) // PASSAGE
    n = np.bincount(passage, minlength=len(out)).astype(np.float64)
    size = (end - start).astype(np.float64)

    def sums(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=len(out))

    def bytes_of(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (total[end] - total[start]).astype(np.float64)

    upper, digits, marks = bytes_of(_UPPER), bytes_of(_DIGIT), bytes_of(_PUNCTUATION)
    letters, beyond = bytes_of(_LETTER), bytes_of(_BEYOND)
    words = span_hashes(data, start, end)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((words, passage))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=len(out))

    total = np.maximum(sums(size), 1)
    some = np.maximum(n, 1)
    mean = sums(size) / some
    columns = [
        mean,
        np.sqrt(np.maximum(sums(size * size) / some - mean**2, 0)),
        sums(upper) / total,
        sums(digits) / total,
        sums(marks) / total,
        sums(beyond) / total,
        sums(again) / some,
        distinct / some,
        sums(letters == 0) / some,
        sums((upper > 1) & (upper + beyond >= letters)) / some,
        sums(_PUNCTUATION[data[end - 1]]) / some,
        sums(_UPPER[data[start]]) / some,
        np.log1p(n),
    ]
    out[:, : len(columns)] = np.stack(columns, axis=1)
    at = np.flatnonzero(_PUNCTUATION[data])
    owner = passage[np.searchsorted(start, at, side="right") - 1]
    seen = np.bincount(owner * _N_MARKS + _MARKS[data[at]], minlength=len(out) * _N_MARKS)
    out[:, len(columns) : len(columns) + _N_MARKS] = seen.reshape(len(out), -1) / some[:, None]
    bucket = (words >> np.uint64(64 - _HASHED.bit_length() + 1)).astype(np.int64)
    seen = np.bincount(passage * _HASHED + bucket, minlength=len(out) * _HASHED)
    out[:, len(columns) + _N_MARKS :] = seen.reshape(len(out), -1) / some[:, None]
    return out, bags


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class AttentionModel:
    """Weights of the encoder's layer ``w``, the attention's two gates and ``a``, and the output ``o``."""

    weights: dict[str, np.ndarray]
    center: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = np.clip((x - self.center) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["wb"])
        t, s = np.tanh(h @ p["v"] + p["vb"]), _logistic(h @ p["u"] + p["ub"])
        e = (t * s) @ p["a"]
        n = np.diff(bags)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags[:-1]), n))
        attention = e / np.repeat(np.add.reduceat(e, bags[:-1]), n)
        z = np.add.reduceat(attention[:, None] * h, bags[:-1])
        score = _logistic(z @ p["o"] + p["ob"])
        return {"x": x, "h": h, "t": t, "s": s, "attention": attention, "z": z, "score": score}

    def gradients(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, f = self.weights, self.forward(x, bags)
        n = np.diff(bags)
        d = (f["score"] - label) / len(label)
        dz = np.repeat(d[:, None] * p["o"][None, :], n, axis=0)
        h, attention = f["h"], f["attention"]
        da = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(attention * da, bags[:-1]), n)
        de = attention * (da - mean)
        dg = de[:, None] * p["a"][None, :]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = attention[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T
        dw = dh * (1 - h**2)
        return {
            "w": f["x"].T @ dw,
            "wb": dw.sum(axis=0),
            "v": h.T @ dt,
            "vb": dt.sum(axis=0),
            "u": h.T @ ds,
            "ub": ds.sum(axis=0),
            "a": (f["t"] * f["s"]).T @ de,
            "o": f["z"].T @ d,
            "ob": np.array(d.sum()),
        }


def train(x: np.ndarray, bags: np.ndarray, label: np.ndarray, seed: int = 7) -> AttentionModel:
    """Adam on batches of documents. Without labels of both kinds the score is their share."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) if len(x) else np.ones(FEATURES)
    shapes = {"w": (FEATURES, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    weights |= {"wb": np.zeros(HIDDEN), "vb": np.zeros(GATE), "ub": np.zeros(GATE)}
    weights |= {"a": rng.normal(0, 1 / np.sqrt(GATE), GATE), "o": np.zeros(HIDDEN)}
    share = (label.sum() + 1) / (len(label) + 2)
    weights["ob"] = np.array(np.log(share / (1 - share)))
    center = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    model = AttentionModel(weights, center, np.where(scale > 1e-6, scale, 1.0))
    if len(np.unique(label)) < 2:
        return model
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for chosen in np.array_split(order, -(-len(order) // BATCH)):
            take = np.concatenate([np.arange(bags[i], bags[i + 1]) for i in chosen])
            own = np.concatenate([[0], np.cumsum(np.diff(bags)[chosen])])
            step += 1
            for k, g in model.gradients(x[take], own, label[chosen]).items():
                g = g + DECAY * weights[k] * (weights[k].ndim > 1)
                m, v = moments[k]
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                moments[k] = (m, v)
                change = m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                weights[k] = weights[k] - RATE * change
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> AttentionModel:
    """Fit on at most ``sample`` labelled documents, those of least id hash.

    Labels other than 0 and 1, and ids whose labels disagree, are left out.
    """
    ids = labels.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label")
    ).filter("id is not null and label in (0, 1)")
    known = ids.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    chosen = known.filter("label = high").select("id", "label").orderBy(F.xxhash64("id"), "id")
    chosen = F.broadcast(chosen.limit(sample))  # ``sample`` rows of two numbers
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), utf8(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, block, offsets in text_blocks(batch.column("text"), lower=False):
                x, bags = encode(block, offsets)
                parts = [x[a:b].tobytes() for a, b in zip(bags[:-1], bags[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, end - first),
                        batch.column("label").slice(first, end - first),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["id", "label", "x"],
                )

    kind = dict(texts.dtypes)["id"]
    coded = map_arrow(texts.join(chosen, "id"), run, f"id {kind}, label int, x binary")
    rows = sorted(coded.collect(), key=lambda r: (r.id, r.x))
    parts = [np.frombuffer(r.x, dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate([np.zeros((0, FEATURES), dtype=np.float32), *parts]).astype(np.float64)
    bags = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return train(x, bags, np.array([r.label for r in rows], dtype=np.float64))


def score(
    docs: DataFrame,
    model: AttentionModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, score, passages, attention (the largest weight).

    Null and empty texts are one empty passage and get its score.
    """
    keep = keep or {}
    inputs = docs.select(
        utf8(text_column).alias("text"),
        F.col(f"`{id_column}`").alias(id_column),
        *[c.alias(n) for n, c in keep.items()],
    )
    return _scored(inputs, model, ["score", "passages", "attention"])


def keep_good(
    docs: DataFrame, model: AttentionModel, text_column: str = "text", least: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` whose texts score at least ``least``, with all their columns."""
    added = [unused(docs.columns, n) for n in ("score", "passages", "attention")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    scored = _scored(docs.select(utf8(text_column).alias("_utf8"), *columns), model, added)
    return scored.filter(F.col(added[0]) >= least).select(*columns)


def _scored(inputs: DataFrame, model: AttentionModel, added: list[str]) -> DataFrame:
    """The columns of ``inputs`` after the first, a text's bytes, and the three of its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, block, offsets in text_blocks(batch.column(0), lower=False):
                x, bags = encode(block, offsets)
                found = model.forward(x, bags)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, end - first) for c in batch.columns[1:]],
                        pa.array(found["score"]),
                        pa.array(np.diff(bags)),
                        pa.array(np.maximum.reduceat(found["attention"], bags[:-1])),
                    ],
                    names=[*batch.schema.names[1:], *added],
                )

    fields = [T.StructField(n, t) for n, t in zip(added, (T.DoubleType(), T.LongType(), T.DoubleType()))]
    return map_arrow(inputs, run, T.StructType([*inputs.schema.fields[1:], *fields]))
