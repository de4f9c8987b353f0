"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. Each cell's token weight is raked:
scaled in turn so that every margin (all sources, all languages, all topics) has its target share,
until all hold at once. A document is then sampled with the probability that gives its cell the raked
share of a token budget; no document is taken twice, so cells whose share asks for more than all of
their tokens give all, and the others make up for them in proportion.

Only the table of cells is iterated on: its size is that of the margins' combinations, not that of
the corpus. Documents are read twice, once to count and once to draw, and never shuffled while the
cells are small enough for Spark to broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .frames import map_arrow, unused, utf8
from .words import SPACED, hashed_words, mix, text_blocks

PLANES = 3  # topics are the cells of so many planes
POWER = 0.5
SHARE = 0.5
SWEEPS, SWEEPS_A_JOB, TOLERANCE = 60, 3, 1e-6


def measure(docs: DataFrame, text: str, tokens: str, topic: str) -> DataFrame:
    """``docs`` with the number of words of each text and its topic added.

    A topic is a cell of ``PLANES`` hyperplanes through the space of word counts: each word is on one
    side of each plane, and the text is where most of its words are. A text without words has topic -1.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    copy = unused(docs.columns, "_utf8")
    source = docs.select(utf8(text).alias(copy), *columns)
    names = [*docs.columns, tokens, topic]
    planes = np.uint64(64 - PLANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, block, offsets in text_blocks(batch.column(0)):
                words, at = hashed_words(block, offsets, SPACED)
                count = np.diff(at)
                sides = mix(words ^ np.uint64(0x70C1C)) >> planes
                cell = np.zeros(len(count), dtype=np.int64)
                for k in range(PLANES):
                    side = ((sides >> np.uint64(k)) & np.uint64(1)).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(side)])
                    cell |= (2 * (total[at[1:]] - total[at[:-1]]) > count).astype(np.int64) << k
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, end - first) for c in batch.columns[1:]],
                        pa.array(count.astype(np.int64)),
                        pa.array(np.where(count > 0, cell, -1).astype(np.int32)),
                    ],
                    names=names,
                )

    schema = docs.select(*columns, F.lit(0).cast("bigint"), F.lit(0)).toDF(*names).schema
    return map_arrow(source, run, schema)


def tempered(cells: DataFrame, margin: str, tokens: str, power: float = POWER) -> DataFrame:
    """``(value, share)``: each value's share of tokens to ``power``, scaled to sum to one."""
    sums = cells.groupBy(F.col(f"`{margin}`").alias("value")).agg(F.sum(f"`{tokens}`").alias("n"))
    raised = sums.filter("n > 0").select("value", F.pow("n", F.lit(power)).alias("share"))
    return raised.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tokens: str, weight: str) -> DataFrame:
    """``cells`` with the column ``weight``: tokens after raking, which have the targets as shares.

    ``targets`` has a table ``(value, share)`` for each margin column; null is a value like others.
    A value without target has share 0, a target without cells is left out, and the rest is scaled
    to one. Raking stops when every margin is within ``TOLERANCE`` of its share, or after ``SWEEPS``
    rounds if the cells can't meet all targets at once.
    """
    table = cells.withColumn(weight, F.col(f"`{tokens}`").cast("double"))
    shares = {m: unused(table.columns, f"_share_{i}") for i, m in enumerate(targets)}
    for margin, target in targets.items():
        own = target.select(F.col("value").alias("_value"), F.col("share").alias(shares[margin]))
        table = table.join(own, F.col(f"`{margin}`").eqNullSafe(F.col("_value")), "left").drop("_value")
    table = table.fillna(0.0, subset=list(shares.values()))
    table = materialize(table, "cells")
    total = table.agg(F.sum(weight)).first()[0] or 0.0
    present = {
        m: table.filter(F.col(weight) > 0).select(m, s).distinct().agg(F.sum(s)).first()[0] or 1.0
        for m, s in shares.items()
    }

    def wanted(margin: str) -> Column:
        return F.col(shares[margin]) / present[margin] * total

    def sums(margin: str) -> Column:
        return F.sum(weight).over(Window.partitionBy(f"`{margin}`"))

    for _ in range(0, SWEEPS, SWEEPS_A_JOB):
        for margin in list(targets) * SWEEPS_A_JOB:
            ratio = F.coalesce(F.try_divide(wanted(margin), sums(margin)), F.lit(0.0))
            table = table.withColumn(weight, F.col(weight) * ratio)
        table = materialize(table, "raked")
        off = [F.max(F.abs(F.col(f"_off_{i}"))) for i in range(len(targets))]
        measured = table.select(
            *[(sums(m) - wanted(m)).alias(f"_off_{i}") for i, m in enumerate(targets)]
        )
        if max((x or 0.0) for x in measured.agg(*off).first()) <= TOLERANCE * max(total, 1.0):
            break
    return table.drop(*shares.values())


def rates(cells: DataFrame, tokens: str, weight: str, budget: float, rate: str) -> DataFrame:
    """``cells`` with the column ``rate``, the share of a cell's tokens to take, at most one.

    Expected tokens sum to ``budget``, or to all tokens of cells with weight if these are fewer.
    """
    need = F.coalesce(F.try_divide(F.col(weight), F.col(f"`{tokens}`").cast("double")), F.lit(0.0))
    scale, full = 0.0, None
    while True:
        capped = F.lit(scale) * need >= 1
        taken, left = cells.agg(
            F.coalesce(F.sum(F.when(capped, F.col(f"`{tokens}`"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col(weight))), F.lit(0.0)),
        ).first()
        if taken == full or left <= 0:
            break
        full, scale = taken, max(scale, (budget - taken) / left)
    return cells.withColumn(rate, F.least(F.lit(1.0), F.lit(scale) * need))


def added_names(columns: Sequence[str]) -> list[str]:
    """The names of the columns that ``mix_sources`` adds to a table with ``columns``."""
    return [unused(columns, n) for n in ("n_tokens", "topic", "rate", "drawn")]


def mix_sources(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    share: float = SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
    margins: Sequence[str] = ("source", "lang"),
    seed: int = 0,
) -> DataFrame:
    """``docs`` with n_tokens, topic, rate and drawn added; the sample is the rows with ``drawn``.

    A name that ``docs`` already has gets underscores in front (``added_names``).

    ``targets`` has shares by margin (``rake``); margins without one get their present shares raised
    to ``POWER`` (``tempered``), so large ones shrink and small ones grow. ``share`` of all tokens is
    the budget. A document is drawn if a hash of seed, id and text is below its cell's rate: the same
    rows give the same sample, and repeated rows are drawn together. Null margins are a value of
    their own. Texts without words have rate 0. An empty table stays empty.
    """
    tokens, topic, rate, drawn = added_names(docs.columns)
    measured = measure(docs, text_column, tokens, topic)
    keys = [*margins, topic]
    targets = {topic if k == "topic" else k: t for k, t in (targets or {}).items()}
    cells = materialize(
        measured.groupBy(*[f"`{k}`" for k in keys]).agg(F.sum(tokens).alias(tokens)), "cell-tokens"
    )
    budget = share * (cells.agg(F.sum(tokens)).first()[0] or 0)
    wanted = {k: targets.get(k) for k in keys}
    shares = {k: tempered(cells, k, tokens) if t is None else t for k, t in wanted.items()}
    weight = unused(docs.columns, "_weight")
    raked = rates(rake(cells, shares, tokens, weight), tokens, weight, budget, rate)
    small = raked.select(*[F.col(f"`{k}`").alias(f"_cell_{i}") for i, k in enumerate(keys)], rate)
    same = [measured[k].eqNullSafe(small[f"_cell_{i}"]) for i, k in enumerate(keys)]
    marked = measured.join(small, same, "left")
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    draw = F.shiftrightunsigned(hashed, 11) / float(1 << 53)
    return marked.withColumn(drawn, draw < F.col(rate)).select(
        *[f"`{c}`" for c in docs.columns], tokens, topic, rate, drawn
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, with its own columns only; ``options`` are those of ``mix_sources``."""
    drawn = added_names(docs.columns)[-1]
    return mix_sources(docs, **options).filter(drawn).select(*[f"`{c}`" for c in docs.columns])
