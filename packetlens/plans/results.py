"""The result table: packets by day of capture, and a manifest for each run that wrote some.

A run replaces the days that it has packets of and no others, so a job that is run again leaves no
packet twice. Rows carry the name of their run, and its manifest is written last: readers see rows of
finished runs only. While a run is replacing a day, that day is the old one, absent, or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, RUN = "capture_date", "run"
MANIFEST_SCHEMA = f"{DAY} date, packets bigint, anomalies bigint, written timestamp, {RUN} string"
_DAY_US = 86_400_000_000


def capture_day(time: str = "event_us") -> Column:
    """The UTC day of a capture time in microseconds; packets without one (null, 0 or less) are of 1970-01-01."""
    known = F.greatest(F.coalesce(F.col(time), F.lit(0)), F.lit(0))
    return F.date_from_unix_date(F.floor(known / _DAY_US).cast("int"))


def write_results(results: DataFrame, path: str, time: str = "event_us") -> str:
    """Write ``results`` to the table at ``path`` by day, then the manifest, and return the run's name.

    Nothing is shuffled: a task writes the days it meets, and a capture in time order has few in each
    split. Columns that ``results`` has by the names ``capture_date`` and ``run`` are replaced.
    """
    spark, run = results.sparkSession, uuid.uuid4().hex
    dated = results.withColumns({DAY: capture_day(time), RUN: F.lit(run)})
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY).parquet(f"{path}/data")
    # Two columns of what is now in the table: one row for each day.
    days = run_results(spark, path, run).groupBy(DAY).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalies"),
        F.current_timestamp().alias("written"),
    )
    days.coalesce(1).write.parquet(f"{path}/manifests/{RUN}={run}")
    return run


def run_results(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The rows that a run wrote and no later one has replaced."""
    return spark.read.parquet(f"{path}/data").filter(F.col(RUN) == run)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``(capture_date, packets, anomalies, written, run)`` of all finished runs, replaced days too."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifests")


def read_results(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """The packets of finished runs, of the days ``first`` to ``last`` (as ``2024-01-31``) if given.

    Only folders of these days are read; the names of finished runs are a small table beside them.
    """
    data, done = spark.read.parquet(f"{path}/data"), read_manifests(spark, path)
    for bound, inside in ((first, F.col(DAY) >= F.to_date(F.lit(first))), (last, F.col(DAY) <= F.to_date(F.lit(last)))):
        if bound is not None:
            data, done = data.filter(inside), done.filter(inside)
    return data.join(done.select(DAY, RUN), [DAY, RUN], "left_semi")


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(capture_date, packets, anomalies)`` from the manifests alone, of each day's last run."""
    last = F.max_by(F.struct("packets", "anomalies"), F.struct("written", RUN))
    return read_manifests(spark, path).groupBy(DAY).agg(last.alias("last")).select(DAY, "last.*")
