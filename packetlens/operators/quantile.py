"""Exact quantiles of a column without collecting its values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Distinct values between two bounds that are counted one by one; more are narrowed down first.
COUNTED_VALUES = 20_000


def exact_quantile(df: DataFrame, column: str, share: float) -> float:
    """The value below which ``share`` of the non-null values lie, between two of them interpolated.

    Approximate quantiles give bounds around the wanted place, each pass counts what lies below them,
    and the next pass looks only between. Sketches and counts are merged across tasks, so the rows
    never meet; the last pass returns at most ``COUNTED_VALUES`` values with their counts. ``df`` is
    read several times: hand in a written table.
    """
    value = F.col(f"`{column}`").cast("double")
    rows = df.select(value.alias("x")).filter("x is not null")
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        raise ValueError(f"No values in {column!r}; it has no quantile.")
    place = (n - 1) * share
    first, last = math.floor(place), math.ceil(place)
    below = 0
    while low < high:
        between = rows.filter(F.col("x").between(low, high))
        if between.select("x").distinct().limit(COUNTED_VALUES + 1).count() <= COUNTED_VALUES:
            break
        inside = between.count()
        margin = 2e-3
        shares = [max((first - below) / inside - margin, 0.0), min((last - below + 1) / inside + margin, 1.0)]
        lower, upper = between.agg(F.percentile_approx("x", shares, 10_000)).first()[0]
        under = rows.filter(F.col("x") < lower).count()
        upto = rows.filter(F.col("x") <= upper).count()
        # A bound on the wrong side of the wanted places is not used.
        lower, under = (lower, under) if under <= first else (low, below)
        upper = upper if upto > last else high
        if (lower, upper) == (low, high):
            break
        low, high, below = lower, upper, under
    counts = rows.filter(F.col("x").between(low, high)).groupBy("x").agg(F.count("*").alias("n"))
    ends, at = [], below
    for x, count in sorted(counts.collect()):
        ends += [x for wanted in (first, last) if at <= wanted < at + count]
        at += count
    return ends[0] + (ends[-1] - ends[0]) * (place - first)
