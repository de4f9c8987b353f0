"""What a job read and what became of it, counted by the passes that run anyway, as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..sources.packets import fits

LEDGER_SCHEMA = "job string, outcome string, rows bigint"


def observe_lines(
    lines: DataFrame, seen: Observation | str, fields: Sequence[str] | None = None
) -> DataFrame:
    """``lines``, counted on their way: all of them, blank ones, packets, and those of another width."""
    blank, packet = is_blank(F.col("value")), fits(F.col("value"), fields)
    return lines.observe(
        seen,
        F.count(F.lit(1)).alias("read"),
        F.count_if(blank).alias("blank"),
        F.count_if(packet).alias("packets"),
        F.count_if(~blank & ~packet).alias("rejected"),
    )


def write_ledger(spark: SparkSession, job: str, counts: dict[str, int], path: str) -> str:
    """One row per outcome; a job that is run again replaces its ledger."""
    rows = [(job, outcome, int(n)) for outcome, n in counts.items()]
    spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return path
