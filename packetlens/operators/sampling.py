"""Exact-size samples in two scans, without a global sort.

The first scan counts rows per class and first digits of a seeded hash: a mergeable sketch, summed in
tasks, of at most ``16 ** DIGITS`` counts a class. From it follow the class sizes, the quotas, and the
digits below which a class's quota of lowest hashes surely lies. The second scan keeps the rows up to
these digits; only those few are written, ordered where they straddle the quota, and cut to size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import NORMAL
from ..sources.schemas import require_columns
from ..sources.workspace import materialize

MAX_LABELLED_ROWS = 500_000

# Class tables are broadcast up to this many classes; beyond it they are joined by shuffle.
BROADCAST_CLASSES = 10_000

# First hexadecimal digits of hashes that are counted: what is kept beyond a quota is 1 in 4,096 rows.
DIGITS = 3


def sample_hash(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *key)))


def _lowest(
    df: DataFrame,
    stratum: str,
    quota: Callable[[Column, int], Column],
    key: Sequence[str],
    seed: int,
) -> DataFrame:
    """Per stratum the rows of lowest hash, as many as ``quota(size, total)``.

    ``key`` must identify a row: rows of equal key hash alike.
    """
    hashed = df.withColumn("_hash", sample_hash(key, seed))
    digits = F.substring("_hash", 1, DIGITS)
    counts = hashed.groupBy(stratum, digits.alias("_digits")).agg(F.count("*").alias("_n"))
    sketch = materialize(counts, "hash-counts")
    sizes = sketch.groupBy(stratum).agg(F.sum("_n").alias("_size"))
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]

    upto = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_digits"))
    quotas = sizes.withColumn("_quota", quota(F.col("_size"), total).cast("bigint"))
    # Null is a class here as well: grouping keeps it, and the join below matches it.
    placed = _by_class(sketch.withColumn("_upto", upto), quotas, stratum)
    reached = F.col("_upto") >= F.least("_quota", "_size")
    bounds = materialize(
        placed.groupBy(stratum, "_quota", "_size").agg(F.min(F.when(reached, F.col("_digits"))).alias("_bound")),
        "hash-bounds",
    )
    few = bounds.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    joined = _by_class(hashed, F.broadcast(bounds) if few else bounds, stratum)
    drawn = materialize(joined.filter(digits <= F.col("_bound")), "drawn")
    return _cut(drawn, stratum, key).select(*df.columns)


def _by_class(left: DataFrame, right: DataFrame, stratum: str, how: str = "inner") -> DataFrame:
    """Join on the class, where null is a class like others."""
    named = right.withColumnRenamed(stratum, "_class")
    return left.join(named, left[stratum].eqNullSafe(named["_class"]), how).drop("_class")


def _cut(drawn: DataFrame, stratum: str, key: Sequence[str]) -> DataFrame:
    """The ``_quota`` rows of lowest hash of each class.

    Rows are counted by class and first digits of the hash, some hundreds of groups to a class. Groups
    below the quota are kept whole; only the one that straddles it is ordered.
    """
    digits = F.greatest(F.ceil(F.log(16.0, F.col("_size") / F.greatest("_quota", F.lit(1)))), F.lit(0))
    drawn = drawn.withColumn("_prefix", F.substring(F.col("_hash"), F.lit(1), (digits + 2).cast("int")))
    counts = drawn.groupBy(stratum, "_prefix").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_prefix")
    counts = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    counts = counts.withColumnRenamed("_prefix", "_group")
    same = [drawn[stratum].eqNullSafe(counts[stratum]), drawn["_prefix"] == counts["_group"]]
    placed = drawn.join(counts, same).drop(counts[stratum])
    whole = placed.filter(F.col("_before") + F.col("_n") <= F.col("_quota"))
    split = placed.filter(
        (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") > F.col("_quota"))
    )
    order = Window.partitionBy(stratum, "_prefix").orderBy("_hash", *key)
    ranked = split.withColumn("_rank", F.row_number().over(order))
    kept = ranked.filter(F.col("_before") + F.col("_rank") <= F.col("_quota")).drop("_rank")
    return whole.unionByName(kept)


def sample_uniform(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, or all of them when there are no more."""
    one = df.withColumn("_stratum", F.lit(0))
    return _lowest(one, "_stratum", lambda size, total: F.lit(n), key, seed).drop("_stratum")


def normal_rows(df: DataFrame, column: str = "attack_type") -> DataFrame:
    require_columns(df, [column])
    return df.filter(F.col(column) == NORMAL)


def sample_stratified(
    df: DataFrame,
    key: Sequence[str],
    column: str = "attack_type",
    max_rows: int = MAX_LABELLED_ROWS,
    seed: int = 42,
) -> DataFrame:
    """``max_rows`` rows in proportion to class size, at least one per class; all rows when few."""

    def quota(size: Column, total: int) -> Column:
        if total <= max_rows:
            return size
        share = F.floor(size.cast("double") * (float(max_rows) / float(total)))
        return F.greatest(F.lit(1).cast("bigint"), share)

    return _lowest(df, column, quota, key, seed)
