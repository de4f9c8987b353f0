"""Alerts on a stream of analyzed packets, in event-time order.

One query. Packets are keyed by sensor, block of time and a share of its instants, so that one busy
sensor is many keys; a key's state holds the sums of its instants until the watermark passes the block's
end, when a timer sends them on and the state is dropped. What comes after that is late: it is sent on
at once, marked, and so kept beside the rest.

Each micro-batch's closed instants then go through the batch operator, in parallel over blocks, from
the few numbers per sensor that the micro-batches before left behind. All tables are written by batch
number, so a batch that is run again replaces what it wrote. Blocks that are open when a run ends stay in
the state; their alerts so far are computed from it, as batch -1, and again after the next run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import ALERT_SCHEMA, CARRIED_SCHEMA, advance_alerts, alert_limits, sensor_name
from ..sources.workspace import job_workspace, materialize, path_exists

INSTANT_SCHEMA = "sensor string, event_us bigint, packets bigint, anomalies bigint, late boolean"
MAX_AHEAD_SECONDS = 60
# Length of a block of time, and the keys that its instants are dealt to.
BLOCK_SECONDS = 30
SHARES = 4
# Instants of one entry of a key's state at most: what arrives at once is one entry, not one for each instant.
ENTRY_INSTANTS = 10_000
OPEN_BATCH = -1

_SUMS = ("event_us", "packets", "anomalies")
_ENTRY = ", ".join(f"{c} array<bigint>" for c in _SUMS)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for queries that start inside; then as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby("event_us", as_index=False)[["packets", "anomalies"]].sum()


def _entries(sums: pd.DataFrame) -> list[tuple[list[int], ...]]:
    """Instants as entries of the state: their columns as arrays, cut to ``ENTRY_INSTANTS``."""
    columns = [sums[c].astype("int64") for c in _SUMS]
    return [
        tuple(c.iloc[at : at + ENTRY_INSTANTS].tolist() for c in columns)
        for at in range(0, len(sums), ENTRY_INSTANTS)
    ]


class BlockProcessor(StatefulProcessor):
    """Holds the instants of one block and sensor until the watermark reaches the block's end."""

    def __init__(self, block_us: int):
        self.block_us = block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instants = handle.getListState("instants", _ENTRY)

    def _sent(self, sensor: str, sums: pd.DataFrame, late: bool) -> pd.DataFrame:
        sums = sums.astype("int64")
        sums.insert(0, "sensor", sensor)
        return sums.assign(late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sensor, block, _ = key
        end_ms = -(-(int(block) + 1) * self.block_us // 1000)
        sums = _summed(pd.concat(list(rows)))
        if timerValues.getCurrentWatermarkInMs() >= end_ms:
            yield self._sent(sensor, sums, True)
        else:
            self.instants.appendList(_entries(sums))
            self.handle.registerTimer(end_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(dict(zip(_SUMS, entry))) for entry in self.instants.get()]
        self.instants.clear()
        if held:
            yield self._sent(key[0], _summed(pd.concat(held)), False)

    def close(self) -> None:
        pass


def stream_instants(
    packets: DataFrame,
    delay: str = "30 seconds",
    sensor: Column | None = None,
    time: Column | None = None,
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Packets and anomalies of each instant of closed blocks, and late ones, marked, as they come.

    Packets are taken at their capture time, or at another ``time`` such as that of their arrival. One
    without a capture time (0 or less) counts at its arrival, and one ahead of its arrival by more
    than ``MAX_AHEAD_SECONDS`` counts there: a wrong clock must not make all later packets late. A
    packet is late if its block has been closed, that is if the watermark, ``delay`` behind the
    latest packet of the batches before, is past the block's end.
    """
    if time is None:
        now = F.current_timestamp()
        ahead = now + F.make_dt_interval(secs=F.lit(MAX_AHEAD_SECONDS))
        known = F.least(F.timestamp_micros("event_us"), ahead)
        time = F.when(F.col("event_us") > 0, known).otherwise(now)
    block_us = block_seconds * 1_000_000
    timed = packets.select(
        sensor_name(sensor).alias("sensor"),
        time.alias("event_time"),
        (F.col("is_anomaly") == 1).cast("bigint").alias("anomalies"),
    ).withWatermark("event_time", delay)
    # Without the time column itself, so that Spark does not drop late rows before they are seen.
    us = F.unix_micros("event_time")
    keyed = timed.select(
        "sensor",
        F.floor(us / block_us).alias("block"),
        F.pmod(F.xxhash64(us), F.lit(SHARES)).cast("int").alias("share"),
        us.alias("event_us"),
        F.lit(1).cast("bigint").alias("packets"),
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
    )
    return keyed.groupBy("sensor", "block", "share").transformWithStateInPandas(
        BlockProcessor(block_us), INSTANT_SCHEMA, "Append", "EventTime"
    )


def _number_before(spark: SparkSession, path: str, number: int) -> int | None:
    """The last batch before ``number`` that left a state."""
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("batch") < number).agg(F.max("batch")).first()[0]


def _carried(spark: SparkSession, path: str, number: int) -> DataFrame:
    last = _number_before(spark, path, number)
    if last is None:
        return spark.createDataFrame([], CARRIED_SCHEMA)
    return spark.read.schema(CARRIED_SCHEMA).parquet(f"{path}/batch={last}")


def follow_alerts(
    points: DataFrame,
    paths: dict[str, str],
    trigger: dict,
    limits: dict[str, tuple[int, int]] | None = None,
) -> StreamingQuery:
    """Start the query that keeps the tables ``instants``, ``alerts`` and ``alert_state`` of ``paths``.

    ``points`` come from ``stream_instants``. Each table has a folder for each batch with rows.
    """
    limits, spark = dict(limits or alert_limits()), points.sparkSession
    spark.createDataFrame([], ALERT_SCHEMA).write.mode("overwrite").parquet(f"{paths['alerts']}/batch={OPEN_BATCH}")

    def write(batch: DataFrame, number: int) -> None:
        session, here = batch.sparkSession, f"{paths['instants']}/batch={number}"
        batch.write.mode("overwrite").parquet(here)
        closed = session.read.schema(INSTANT_SCHEMA).parquet(here).filter("not late")
        if closed.isEmpty():
            return
        with job_workspace(session):
            found, state = advance_alerts(closed, _carried(session, paths["alert_state"], number), limits)
            found.write.mode("overwrite").parquet(f"{paths['alerts']}/batch={number}")
            # Last: with it the batch counts as done for the batches after it.
            state.write.mode("overwrite").parquet(f"{paths['alert_state']}/batch={number}")

    with _state_store(spark):
        writer = points.writeStream.option("checkpointLocation", f"{paths['instants']}_checkpoint")
        return writer.foreachBatch(write).trigger(**trigger).start()


def open_instants(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The instants that a run which has ended left in its state: those of blocks that are still open."""
    with _state_store(spark):
        state = spark.read.format("statestore").option("stateVarName", "instants")
        rows = state.load(f"{paths['instants']}_checkpoint")
        entry = F.arrays_zip(*[F.col(f"list_element.{c}").alias(c) for c in _SUMS])
        held = rows.select(F.col("key.sensor").alias("sensor"), F.inline(entry))
        sums = held.groupBy("sensor", "event_us").agg(
            F.sum("packets").alias("packets"), F.sum("anomalies").alias("anomalies")
        )
        return materialize(sums, "open-instants")


def close_alerts(
    spark: SparkSession, paths: dict[str, str], limits: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Alerts in open blocks after a run, as batch -1 of the table, and the whole table."""
    limits = dict(limits or alert_limits())
    carried = _carried(spark, paths["alert_state"], 1 << 60)
    with job_workspace(spark):
        found, _ = advance_alerts(open_instants(spark, paths), carried, limits)
        found.write.mode("overwrite").parquet(f"{paths['alerts']}/batch={OPEN_BATCH}")
    return alerts_table(spark, paths)


def alerts_table(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All alerts, without the number of their batch."""
    return spark.read.schema(ALERT_SCHEMA).parquet(paths["alerts"]).drop("batch")


def late_packets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Late packets and anomalies of each sensor, and those that came in time and are closed."""
    rows = spark.read.schema(INSTANT_SCHEMA).parquet(paths["instants"])

    def total(column: str, late: bool) -> Column:
        return F.sum(F.when(F.col("late") == late, F.col(column)).otherwise(0))

    return rows.groupBy("sensor").agg(
        total("packets", True).alias("late_packets"),
        total("anomalies", True).alias("late_anomalies"),
        total("packets", False).alias("closed_packets"),
    )
