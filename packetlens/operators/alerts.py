"""Sliding-window rates and alerts that reset their counter when they fire.

Packets are first summed per sensor and microsecond, with map-side partial sums. All later steps see
one row per instant, so a burst, however large, is one row. Blocks of time are the groups of the running
sums, which Spark sorts and spills; for the steps below each block is cut into parts of ``PART`` instants
at most, so that a group that pandas sees is bounded however dense its sensor is.

An alert fires at the j-th event of its sensor when events j-K..j lie within the window and at least
K+1 events came since the last alert. Whether the first condition holds is local to a window, but the
second couples the whole session. It is resolved in three steps that never put a session's events into
one task:

1. per part: where the next alert may start on leaving it, for each of the K+1 possible states on
   entering it (``_part_table``);
2. tables of consecutive parts are composed to those of blocks and longer spans, and the states on
   entry are handed down from span to part, so that no group grows with the session (``_chain_parts``);
3. per part: the alerts, now that the state on entry is known (``_part_alerts``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize

ANOMALY_WINDOW_SECONDS = 10
ANOMALY_THRESHOLD = 5
TRAFFIC_WINDOW_SECONDS = 1
TRAFFIC_THRESHOLD = 200

# Alert messages.
MESSAGES = {
    "anomaly": "🚨 High anomaly rate detected",
    "traffic": "⚠️ Traffic spike detected",
}
MEASURES = {"anomaly": "anomalies", "traffic": "packets"}

ALERT_SCHEMA = "sensor string, kind string, event_us bigint, rn bigint, count bigint, message string"
# What the packets so far leave behind: events seen, the least event that may fire next, last instants.
CARRIED_SCHEMA = (
    "sensor string, kind string, seen bigint, allowed bigint, tail array<struct<event_us:bigint,n:bigint>>"
)

# Alerts of all kinds are found in one pass; each kind and sensor has a chain of blocks.
KEY = ("kind", "sensor")
_KEY = "kind string, sensor string"

_SECOND = 1_000_000
_BLOCK = 10 * _SECOND
_CHUNK = 10_000
PART = 100_000  # instants of a block that one group holds
FAN, LEVELS = 256, 2  # blocks composed to one, and how often: 7.6 days at blocks of 10 seconds


def alert_limits(
    anomaly_window: float = ANOMALY_WINDOW_SECONDS,
    anomaly_threshold: int = ANOMALY_THRESHOLD,
    traffic_window: float = TRAFFIC_WINDOW_SECONDS,
    traffic_threshold: float = TRAFFIC_THRESHOLD,
) -> dict[str, tuple[int, int]]:
    """Per alert kind the window in microseconds and the count that must be exceeded.

    The traffic threshold is a rate per second over a window that counts as one second at least.
    """
    if anomaly_threshold < 0 or traffic_threshold < 0 or anomaly_window < 0 or traffic_window < 0:
        raise ValueError("Windows and thresholds must not be negative.")
    return {
        "anomaly": (round(anomaly_window * _SECOND), math.floor(anomaly_threshold)),
        "traffic": (
            round(traffic_window * _SECOND),
            math.floor(traffic_threshold * max(traffic_window, 1)),
        ),
    }


def sensor_name(sensor: Column | None) -> Column:
    """Whose packets are counted together; a packet without a sensor counts under empty text."""
    return F.lit("all") if sensor is None else F.coalesce(sensor.cast("string"), F.lit(""))


def instants(
    packets: DataFrame, sensor: Column | None = None, time: str = "event_us", flag: str = "is_anomaly"
) -> DataFrame:
    """Packets and anomalies per sensor and microsecond."""
    return packets.groupBy(
        sensor_name(sensor).alias("sensor"),
        F.col(time).alias("event_us"),
    ).agg(
        F.count("*").alias("packets"),
        F.sum((F.col(flag) == 1).cast("bigint")).alias("anomalies"),
    )


def _width(window_us: int) -> int:
    """Block width: several windows, so that few rows are copied to the block after theirs."""
    return max(4 * window_us, _BLOCK)


def _counted(points: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """``(kind, sensor, event_us, n, window, width, old)``: instants once for each kind, for one pass."""
    kinds = [
        F.struct(
            F.lit(kind).alias("kind"),
            "sensor",
            "event_us",
            F.col(MEASURES[kind]).cast("bigint").alias("n"),
            F.lit(window_us).cast("bigint").alias("window"),
            F.lit(_width(window_us)).cast("bigint").alias("width"),
            F.lit(False).alias("old"),
        )
        for kind, (window_us, _) in limits.items()
    ]
    return points.select(F.inline(F.array(*kinds)))


def _within(us: Column) -> Column:
    """Microseconds since the block began."""
    return F.pmod(us, F.col("width"))


def _block(us: Column) -> Column:
    return ((us - _within(us)) / F.col("width")).cast("bigint")


def _is_tail(us: Column) -> Column:
    """Whether a window of the next block can reach this instant."""
    return _within(us) >= F.col("width") - F.col("window")


def _parts(limits: dict[str, tuple[int, int]]) -> int:
    """The most parts that a block of any kind can have: it has no more instants than microseconds."""
    return max(-(-_width(window_us) // PART) for window_us, _ in limits.values())


def _positions(points: DataFrame) -> DataFrame:
    """Per instant of ``_counted`` points: events up to and with it (``upto``) and before its window
    starts (``before``), and its place among the block's instants (``place``, from 0).

    Events count from one window before the block, whose rows are copied into the block as context. So
    are ``old`` points, which have been through before. A running sum replaces a sliding frame, which would read every window anew.
    """
    us, n, window_us = F.col("event_us"), F.col("n"), F.col("window")
    block = _block(us)
    nobody = F.lit(None).cast("bigint")
    own_us = F.when(~F.col("old"), us)

    def row(block: Column, at: Column, is_event: int, n: Column, owner: Column) -> Column:
        return F.struct(
            block.alias("block"), at.alias("at"), F.lit(is_event).alias("is_event"),
            n.alias("n"), owner.alias("event_us"),
        )

    own = [row(block, us, 1, n, own_us), row(block, us - window_us, 0, F.lit(0).cast("bigint"), own_us)]
    context = row(block + 1, us, 1, n, nobody)
    rows = points.select(
        *KEY, F.inline(F.when(_is_tail(us), F.array(*own, context)).otherwise(F.array(*own)))
    )
    order = Window.partitionBy(*KEY, "block").orderBy("at", "is_event")
    up_to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    is_event = F.col("is_event") == 1
    owned = F.col("event_us").isNotNull()
    return (
        rows.withColumn("running", F.sum("n").over(up_to_here))
        .withColumn("instants", F.count_if(is_event & owned).over(up_to_here))
        .filter(owned)
        .groupBy(*KEY, "block", "event_us")
        .agg(
            F.max(F.when(is_event, F.col("n"))).alias("n"),
            F.max(F.when(is_event, F.col("running"))).alias("upto"),
            F.max(F.when(~is_event, F.col("running"))).alias("before"),
            F.max(F.when(is_event, F.col("instants") - 1)).alias("place"),
        )
    )


def window_counts(points: DataFrame, measure: str, window_us: int) -> DataFrame:
    """Events in the closed window that ends at each instant."""
    kind = next(k for k, m in MEASURES.items() if m == measure)
    return _positions(_counted(points, {kind: (window_us, 0)})).select(
        "sensor", "event_us", (F.col("upto") - F.col("before")).alias("window_count")
    )


def with_window_counts(
    packets: DataFrame, window_us: int, measure: str = "packets", sensor: Column | None = None
) -> DataFrame:
    """Every packet with ``window_count``: events of its sensor in the window that ends at it.

    One instant's packets can be many, but the other side of the join has one row per instant, so
    AQE may split a hot instant over tasks.
    """
    keyed = packets.withColumn("_sensor", sensor_name(sensor))
    counts = window_counts(instants(keyed, F.col("_sensor")), measure, window_us)
    return keyed.join(
        counts.withColumnRenamed("sensor", "_sensor"), ["_sensor", "event_us"]
    ).drop("_sensor")


def _table(lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Next allowed position after the intervals, for starts ``lo[0] .. lo[0]+k``."""
    state = lo[0] + np.arange(k + 1, dtype=np.int64)
    while True:
        at = np.searchsorted(hi, state, "left")
        live = at < len(hi)
        if not live.any():
            return state
        first = np.maximum(state[live], lo[at[live]])
        state[live] = first + ((hi[at[live]] - first) // (k + 1) + 1) * (k + 1)


Thresholds = dict[str, int]


def _part_table(ks: Thresholds):
    def table(key: tuple[Any, ...], candidates: pd.DataFrame) -> pd.DataFrame:
        kind, sensor, node = key
        candidates = candidates.sort_values("lo")
        lo, hi = candidates["lo"].to_numpy(), candidates["hi"].to_numpy()
        out = _table(lo, hi, ks[kind])
        if (out == out[0]).all():
            out = out[:1]
        return pd.DataFrame(
            {"kind": [kind], "sensor": [sensor], "node": [node], "first": [lo[0]], "out": [out]}
        )

    return table


def _runs(nodes: pd.DataFrame):
    """Sorted nodes one after another: ``(node, events before it, first, out)``, relative to the first."""
    nodes = nodes.sort_values("node")
    total = nodes["total"].to_numpy()
    return zip(nodes["node"], np.cumsum(total) - total, nodes["first"], nodes["out"])


def _leave(state: np.ndarray, first: int, out: np.ndarray, k: int) -> np.ndarray:
    """Next allowed positions after a node, given those on entry; both relative to the node's start."""
    return out[np.clip(state - first, 0, k) if len(out) > 1 else np.zeros(len(state), dtype=np.int64)]


def _composed(ks: Thresholds):
    """The table of some nodes in a row, from theirs."""

    def compose(key: tuple[Any, ...], nodes: pd.DataFrame) -> pd.DataFrame:
        kind, sensor, node = key
        k, first, state = ks[kind], None, None
        for _, before, own, out in _runs(nodes):
            if out is None:
                continue
            if state is None:
                first = int(before + own)
                state = first + np.arange(k + 1, dtype=np.int64)
            state = before + _leave(state - before, int(own), out, k)
        if state is not None and (state == state[0]).all():
            state = state[:1]
        whole = int(nodes["total"].sum())
        row = {"kind": [kind], "sensor": [sensor], "node": [node], "total": [whole], "first": [first], "out": [state]}
        return pd.DataFrame(row).astype({"first": "Int64"})

    return compose


def _entered(ks: Thresholds):
    """Events before each node and the next allowed position on entry, from those of the parent."""

    def enter(
        key: tuple[Any, ...], nodes: pd.DataFrame, parent: pd.DataFrame
    ) -> pd.DataFrame:
        kind, sensor = key[:2]
        rows, start, state = [], 0, np.zeros(1, dtype=np.int64)
        if len(parent):
            start = int(parent["start"].iloc[0])
            state[0] = parent["allowed"].iloc[0] - start
        for node, before, first, out in _runs(nodes):
            rows.append((kind, sensor, int(node), start + int(before), start + int(state[0])))
            if out is not None:
                state = before + _leave(state - before, int(first), out, ks[kind])
        return pd.DataFrame(rows, columns=["kind", "sensor", "node", "start", "allowed"])

    return enter


def _chain_parts(parts: DataFrame, ks: Thresholds, before: DataFrame, fans: Sequence[int]) -> DataFrame:
    """``(*KEY, node, start, allowed)`` of parts from ``(*KEY, node, total, first, out)``.

    ``before`` has ``(*KEY, start, allowed)`` of sensors that had packets before these parts.

    Tables of consecutive nodes are composed, as many to one as ``fans`` says for each level, and then
    the entries are handed down again, so no group has more rows than that but the topmost.
    """
    kinds = f"{_KEY}, node bigint, total bigint, first bigint, out array<bigint>"
    entries = f"{_KEY}, node bigint, start bigint, allowed bigint"
    levels = [parts]
    for fan in fans:
        above = levels[-1].groupBy(*KEY, F.floor(F.col("node") / fan).alias("node"))
        levels.append(above.applyInPandas(_composed(ks), kinds))
    enter = _entered(ks)
    top = levels.pop().groupBy(*KEY).cogroup(before.groupBy(*KEY))
    entered = top.applyInPandas(lambda key, own, parent: enter(key, own, parent), entries)
    for nodes, fan in zip(reversed(levels), reversed(fans)):
        parents = entered.withColumnRenamed("node", "parent")
        entered = (
            nodes.withColumn("parent", F.floor(F.col("node") / fan))
            .groupBy(*KEY, "parent")
            .cogroup(parents.groupBy(*KEY, "parent"))
            .applyInPandas(lambda key, own, parent: enter(key, own, parent), entries)
        )
    return entered


def _part_alerts(ks: Thresholds):
    def alerts(
        key: tuple[Any, ...], candidates: pd.DataFrame, start: pd.DataFrame
    ) -> pd.DataFrame:
        (kind, sensor), rows = key[:2], []
        candidates, step = candidates.sort_values("lo"), ks[kind] + 1
        lo, hi = candidates["lo"].to_numpy(), candidates["hi"].to_numpy()
        us = candidates["event_us"].to_numpy()
        if len(lo) and len(start):
            base, state = int(start["base"].iloc[0]), int(start["allowed"].iloc[0])
            at = int(np.searchsorted(hi, state, "left"))
            while at < len(hi):
                first = max(state, int(lo[at]))
                fired = (int(hi[at]) - first) // step + 1
                rows.append((kind, sensor, int(us[at]), base + first, fired))
                state = first + fired * step
                at += int(np.searchsorted(hi[at:], state, "left"))
        return pd.DataFrame(rows, columns=["kind", "sensor", "event_us", "first_rn", "fired"])

    return alerts


def _of_kind(values: dict) -> Column:
    """The value of each row's kind."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("kind")]


def expand_alerts(fired: DataFrame, ks: Thresholds) -> DataFrame:
    """One row per alert from rows of ``fired`` alerts that are ``k + 1`` events apart.

    An instant may fire any number of them: they are cut into chunks that are spread over tasks.
    """
    step = _of_kind({kind: k + 1 for kind, k in ks.items()}).cast("bigint")
    last = F.col("fired") - 1
    chunks = fired.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(_CHUNK).cast("bigint"))))
    numbers = chunks.repartition(*KEY, "event_us", "_chunk").withColumn(
        "_i", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + (_CHUNK - 1), last)))
    )
    return numbers.select(
        "sensor",
        "kind",
        "event_us",
        (F.col("first_rn") + F.col("_i") * step).alias("rn"),
        step.alias("count"),
        _of_kind({kind: MESSAGES[kind] for kind in ks}).alias("message"),
    )


def _fired(
    points: DataFrame, limits: dict[str, tuple[int, int]], entered: DataFrame, levels: int = LEVELS
) -> DataFrame:
    """``(*KEY, event_us, first_rn, fired)`` of ``_counted`` points.

    ``entered`` has ``(*KEY, start, allowed)``: events before the first point, and the least that may fire.
    Blocks are composed ``levels`` times, after their parts.
    """
    ks = {kind: k for kind, (_, k) in limits.items()}
    n, upto, before = F.col("n"), F.col("upto"), F.col("before")
    step = _of_kind({kind: k + 1 for kind, k in ks.items()})
    parts = _parts(limits)
    # Written once: three steps read it, and the running sums are the costly one.
    placed = materialize(
        _positions(points).select(
            *KEY,
            (F.col("block") * parts + F.floor(F.col("place") / PART)).alias("node"),
            "event_us", "n", "upto",
            F.greatest(upto - n + 1, before + step).alias("lo"), upto.alias("hi"),
        ),
        "alert-positions",
    )
    candidates = placed.filter("lo <= hi").select(*KEY, "node", "event_us", "lo", "hi")
    tables = candidates.groupBy(*KEY, "node").applyInPandas(
        _part_table(ks), f"{_KEY}, node bigint, first bigint, out array<bigint>"
    )
    # ``copied``: events before the part that its positions count, of its block and of context.
    totals = placed.groupBy(*KEY, "node").agg(F.sum("n").alias("total"), F.min(upto - n).alias("copied"))
    nodes = materialize(totals.join(tables, [*KEY, "node"], "left"), "alert-parts")
    chained = _chain_parts(
        nodes.select(
            *KEY,
            "node",
            "total",
            (F.col("first") - F.col("copied")).alias("first"),
            F.transform("out", lambda x: x - F.col("copied")).alias("out"),
        ),
        ks,
        entered,
        [parts, *[FAN] * levels],
    )
    starts = (
        nodes.filter("first is not null")
        .select(*KEY, "node", "copied")
        .join(chained, [*KEY, "node"])
        .withColumn("base", F.col("start") - F.col("copied"))
        .select(*KEY, "node", "base", (F.col("allowed") - F.col("base")).alias("allowed"))
    )
    return (
        candidates.groupBy(*KEY, "node")
        .cogroup(starts.groupBy(*KEY, "node"))
        .applyInPandas(_part_alerts(ks), f"{_KEY}, event_us bigint, first_rn bigint, fired bigint")
    )


def find_alerts(points: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """All alerts of the given kinds. ``rn`` numbers the sensor's events of that kind in time order
    and names the one that fired; ``points`` come from ``instants``."""
    limits = limits or alert_limits()
    ks = {kind: k for kind, (_, k) in limits.items()}
    nothing = points.sparkSession.createDataFrame([], f"{_KEY}, start bigint, allowed bigint")
    return expand_alerts(_fired(_counted(points, limits).filter("n > 0"), limits, nothing), ks)


def advance_alerts(
    points: DataFrame, carried: DataFrame, limits: dict[str, tuple[int, int]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Alerts of ``points`` that follow earlier ones in time, and what these and they leave behind.

    ``carried`` is what the points before left (``CARRIED_SCHEMA``; empty at first). Of these only
    each sensor's last K+1 instants are needed: an alert needs K+1 events in its window, and those
    before them change nothing. So a long session can be gone through in parts of any size, with the
    alerts of the whole.
    """
    limits = limits or alert_limits()
    ks = {kind: k for kind, (_, k) in limits.items()}
    own = _counted(points, limits).filter("n > 0")
    tail = carried.select(*KEY, F.inline("tail"), F.lit(True).alias("old"))
    for column in ("window", "width"):
        sizes = {kind: w if column == "window" else _width(w) for kind, (w, _) in limits.items()}
        tail = tail.withColumn(column, _of_kind(sizes).cast("bigint"))
    both = own.unionByName(tail)
    entered = carried.select(*KEY, F.col("seen").alias("start"), "allowed")
    # A micro-batch has few blocks, and each level costs it two more steps.
    fired = materialize(_fired(both, limits, entered, levels=LEVELS - 1), "fired")

    step = _of_kind({kind: k + 1 for kind, k in ks.items()})
    latest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("event_us")))
    kept = both.withColumn("_place", latest).filter(F.col("_place") <= max(ks.values()) + 1)
    kept = kept.filter(F.col("_place") <= step)
    parts = [
        carried.select(*KEY, "seen", "allowed"),
        own.groupBy(*KEY).agg(F.sum("n").alias("seen")),
        fired.groupBy(*KEY).agg(F.max(F.col("first_rn") + F.col("fired") * step).alias("allowed")),
        kept.groupBy(*KEY).agg(F.collect_list(F.struct("event_us", "n")).alias("tail")),
    ]
    left = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    state = left.groupBy(*KEY).agg(
        F.coalesce(F.sum("seen"), F.lit(0)).cast("bigint").alias("seen"),
        F.coalesce(F.max("allowed"), F.lit(0)).cast("bigint").alias("allowed"),
        F.first("tail", ignorenulls=True).alias("tail"),
    )
    return expand_alerts(fired, ks), state
