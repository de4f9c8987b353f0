"""Shards of equal size in uniformly random order, by a hypergeometric communication matrix.

1. Rows are numbered and written once, dealt to source partitions by a hash of their number, and
   counted. There are more partitions with more rows, so that none outgrows a task.
2. A matrix says how many rows each partition sends to each shard. Its row sums are the partitions'
   counts, its column sums the shards' exact sizes, and it is drawn as a uniformly random
   permutation of all rows would make it: the counts of one half of the partitions are multivariate
   hypergeometric given the whole, and so on by halves down to single partitions.
3. Rows are ordered at random within their partition; the first go to shard 0, the next to shard 1
   and so on, as many as the matrix says.
4. Rows are exchanged, and ordered at random within their shard. Slots are numbered from bucket
   counts, so a shard need not fit one task.

Steps 3 and 4 order and exchange row numbers; the rows themselves move once, to join their places.

Only DataFrame functions are used. The matrix is drawn in SQL from a hash of a seed: the same rows
and seed give the same shards, also when tasks are run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .frames import let, unused

SHARDS = 16
PARTITIONS = 128  # at least
ROWS_PER_PARTITION = 1_000_000
ROWS_PER_BUCKET = 100_000
BROADCAST_BYTES = 64 << 20  # a larger matrix is joined by shuffle

_HALF_LOG_TAU = 0.9189385332046727


def _draw(*parts) -> Column:
    """A number in (0, 1) from a hash of ``parts``."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def _log_factorial(n: Column) -> Column:
    """ln n! to about 1e-12 by Stirling's series, on n + 8 with the factors between taken off."""
    x = n.cast("double") + 9
    near = F.lit(1.0)
    for k in range(1, 9):
        near = near * (n + k)
    inverse = F.lit(1.0) / x
    series = inverse / 12 - F.pow(inverse, 3) / 360 + F.pow(inverse, 5) / 1260
    return (x - 0.5) * F.log(x) - x + _HALF_LOG_TAU + series - F.log(near)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked`` ones, by inversion of ``u``.

    The distribution is summed outwards from its mode, to both sides in turn, until ``u`` is used
    up: some standard deviations' worth of steps, whatever the numbers. Every value has its own
    probability to rounding, so the draw is exact but for that.
    """
    unmarked = total - marked
    low = F.greatest(F.lit(0).cast("bigint"), drawn - unmarked)
    high = F.least(drawn, marked)
    share = (drawn + 1).cast("double") * (marked + 1).cast("double") / (total + 2).cast("double")
    top = F.least(F.greatest(F.floor(share).cast("bigint"), low), high)
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    some = F.greatest(n, F.lit(1.0))
    spread = F.sqrt(d * (k / some) * (1 - d / some))
    steps = F.least(F.ceil(spread * 14 + 60), high - low).cast("int")

    def chance(mode: Column) -> Column:
        logs = [(marked, 1), (mode, -1), (marked - mode, -1)]
        logs += [(unmarked, 1), (drawn - mode, -1), (unmarked - drawn + mode, -1)]
        logs += [(total, -1), (drawn, 1), (total - drawn, 1)]
        terms = F.array(*[F.struct(n.cast("bigint").alias("n"), F.lit(sign).alias("sign")) for n, sign in logs])
        added = F.aggregate(
            terms, F.lit(0.0), lambda a, t: a + t["sign"] * _log_factorial(t["n"])
        )
        return F.exp(added)

    def start(mode: Column, p: Column) -> Column:
        return F.struct(
            (u - p).alias("left"),
            p.alias("up"),
            p.alias("down"),
            mode.alias("above"),
            mode.alias("below"),
            mode.alias("value"),
        )

    def step(s: Column, _: Column) -> Column:
        a, b = s["above"].cast("double"), s["below"].cast("double")
        rise = (s["above"] < high) & (s["left"] > 0)
        up = F.when(rise, s["up"] * ((k - a) / (a + 1)) * ((d - a) / (n - k - d + a + 1)))
        up = F.coalesce(up, F.lit(0.0))
        after = s["left"] - up
        fall = (s["below"] > low) & (after > 0)
        down = F.when(fall, s["down"] * (b / (k - b + 1)) * ((n - k - d + b) / (d - b + 1)))
        down = F.coalesce(down, F.lit(0.0))
        return F.struct(
            F.when(s["left"] > 0, after - down).otherwise(s["left"]).alias("left"),
            F.when(rise, up).otherwise(s["up"]).alias("up"),
            F.when(fall, down).otherwise(s["down"]).alias("down"),
            F.when(rise, s["above"] + 1).otherwise(s["above"]).alias("above"),
            F.when(fall, s["below"] - 1).otherwise(s["below"]).alias("below"),
            F.when(rise & (after <= 0), s["above"] + 1)
            .when(fall & (after - down <= 0), s["below"] - 1)
            .otherwise(s["value"])
            .alias("value"),
        )

    walk = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    begin = let(top, lambda mode: let(chance(mode), lambda p: start(mode, p)))
    return F.aggregate(walk, begin, step, lambda s: s["value"])


def _shares(needs: Column, drawn: Column, seed: Column) -> Column:
    """Multivariate hypergeometric: how many of each of ``needs`` are among ``drawn`` of them all."""
    whole = F.aggregate(needs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    begin = F.struct(
        whole.alias("total"),
        drawn.alias("drawn"),
        F.lit(0).alias("at"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(s: Column, need: Column) -> Column:
        u = _draw(seed, s["at"])
        got = hypergeometric(s["total"], need, s["drawn"], u)
        return let(
            got,
            lambda x: F.struct(
                (s["total"] - need).alias("total"),
                (s["drawn"] - x).alias("drawn"),
                (s["at"] + 1).alias("at"),
                F.concat(s["out"], F.array(x)).alias("out"),
            ),
        )

    return F.aggregate(needs, begin, step, lambda s: s["out"])


def communication_matrix(counts: DataFrame, shards: int, partitions: int, seed: int) -> DataFrame:
    """``(part, needs)``: how many rows a partition sends to each shard, as an array.

    ``counts(part, n)`` has partitions from 0 to ``partitions`` - 1, which is a power of two. Shards'
    sizes differ by one at most. A partition that isn't there has no rows.
    """
    place = F.map_from_entries(F.collect_list(F.struct("part", "n")))
    none = F.lit(0).cast("bigint")
    root = counts.agg(place.alias("m"), F.coalesce(F.sum("n"), none).alias("total")).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(partitions - 1)),
            lambda p: F.coalesce(F.try_element_at("m", p), none),
        ).alias("sizes"),
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.floor(F.col("total") / shards)
            + (s < F.col("total") % shards).cast("bigint"),
        ).alias("needs"),
        F.lit(1).cast("bigint").alias("node"),
    )
    level, width = root, partitions
    while width > 1:
        width //= 2
        left = F.slice("sizes", 1, width)
        drawn = F.aggregate(left, none, lambda a, x: a + x)
        level = level.select(
            "node", "sizes", "needs",
            _shares(F.col("needs"), drawn, F.xxhash64(F.lit(seed), "node")).alias("taken"),
        )
        rest = F.zip_with("needs", "taken", lambda a, b: a - b)
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("sizes"), F.col("taken").alias("needs")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.slice("sizes", width + 1, width).alias("sizes"),
                rest.alias("needs"),
            ),
        )
        level = level.select(F.inline(halves))
    return level.select((F.col("node") - partitions).cast("int").alias("part"), "needs")


def source_partitions(rows: int) -> int:
    """How many source partitions so many rows are dealt to: a power of two."""
    return max(PARTITIONS, 1 << max(-(-rows // ROWS_PER_PARTITION) - 1, 0).bit_length())


def shard(
    df: DataFrame,
    shards: int = SHARDS,
    partitions: int | None = None,
    seed: int = 0,
    shard_column: str = "shard",
    slot_column: str = "slot",
) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot`` added.

    Shards are 0 to ``shards`` - 1 and their sizes differ by one at most; slots count from 0 within a
    shard without gaps. Every assignment of rows to places is equally likely over seeds. Rows that
    are equal in all columns, nulls included, get places of their own. An empty table stays empty.
    If ``df`` already has a column of an added name, the added one gets underscores in front.
    ``partitions`` is a power of two, by default ``source_partitions`` of the number of rows.
    """
    shard_column = unused(df.columns, shard_column)
    slot_column = unused(df.columns, slot_column)
    row = unused(df.columns, "_row")
    # Rows are numbered once and written, so that equal rows differ and every pass sees the same.
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    partitions = partitions or source_partitions(rows.count())
    places = _places(rows.select(F.col(row).alias("row")), shards, partitions, seed)
    places = places.toDF(row, shard_column, slot_column)
    return rows.join(places, row).select(*[f"`{c}`" for c in df.columns], shard_column, slot_column)


def _places(rows: DataFrame, shards: int, partitions: int, seed: int) -> DataFrame:
    """``(row, shard, slot)`` for a table of row numbers: only these are ordered and exchanged twice."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit("part"), "row"), F.lit(partitions)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    matrix = materialize(communication_matrix(counts, shards, partitions, seed), "matrix")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row")
    # The shard of the i-th row is the number of running sums of the needs that are below i.
    to = F.aggregate(
        "needs",
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("shard")),
        lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"),
            (s["shard"] + (s["sum"] + x < F.col("order")).cast("int")).alias("shard"),
        ),
        lambda s: s["shard"],
    )
    buckets = max(int(total // (shards * ROWS_PER_BUCKET)), 1) * 4
    mark = F.xxhash64(F.lit(seed), F.lit("slot"), "row")
    if 8 * partitions * shards <= BROADCAST_BYTES:  # ``partitions`` rows of ``shards`` numbers
        matrix = F.broadcast(matrix)
    sent = (
        rows.join(matrix, "part")
        .withColumn("order", F.row_number().over(local).cast("bigint"))
        .select(
            "row",
            to.alias("shard"),
            F.pmod(F.shiftrightunsigned(mark, 8), F.lit(buckets)).cast("int").alias("bucket"),
        )
    )
    sizes = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket")
    bases = sizes.select("shard", "bucket", (F.sum("n").over(before) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy(mark, "row")
    placed = sent.join(bases, ["shard", "bucket"])
    return placed.select(
        "row", "shard", (F.col("base") + F.row_number().over(within) - 1).alias("slot")
    )
