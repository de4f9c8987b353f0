"""Report tables. All counts come from one small table of counts per flag and attack type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import anomaly_flag, attack_label
from ..functions.text import strip
from ..sources.schemas import require_columns


def normalize_flags(df: DataFrame, column: str = "is_anomaly") -> DataFrame:
    return df.withColumn(column, anomaly_flag(F.col(column), df.schema[column].dataType))


def prepare_report(df: DataFrame) -> DataFrame:
    """Flags as 0/1 and a null attack type as ``unknown``."""
    require_columns(df, ["is_anomaly", "attack_type"])
    named = F.coalesce(F.col("attack_type").cast("string"), F.lit("unknown"))
    return df.transform(normalize_flags).withColumn("attack_type", named)


def outcome_counts(prepared: DataFrame) -> DataFrame:
    """Packets per flag and attack type: a few rows, from map-side partial counts."""
    return prepared.groupBy("is_anomaly", "attack_type").agg(F.count("*").alias("packets"))


def traffic_distribution(counts: DataFrame) -> DataFrame:
    """Total, anomalous and normal packets, one row."""
    anomalies = F.coalesce(F.sum(F.when(F.col("is_anomaly") == 1, F.col("packets"))), F.lit(0))
    total = F.coalesce(F.sum("packets"), F.lit(0))
    return counts.agg(
        total.alias("total_packets"),
        anomalies.cast("bigint").alias("anomalies"),
        (total - anomalies).cast("bigint").alias("normal"),
    )


def attack_distribution(counts: DataFrame) -> DataFrame:
    """Packets per attack type, most frequent first, equal counts by name."""
    return (
        counts.groupBy("attack_type")
        .agg(F.sum("packets").alias("packets"))
        .orderBy(F.desc("packets"), "attack_type")
    )


def attack_share(counts: DataFrame) -> DataFrame:
    """Percent of packets per attack type, to one decimal."""
    per_type = counts.groupBy("attack_type").agg(F.sum("packets").alias("packets"))
    total = counts.agg(F.sum("packets")).scalar()
    share = F.round(F.lit(100.0) * F.col("packets") / total, 1)
    return per_type.select("attack_type", "packets", share.alias("percent"))


def attack_summary(df: DataFrame) -> DataFrame:
    """Packets per attack type where nulls are a type of their own, called ``nan``."""
    require_columns(df, ["attack_type"])
    label = F.coalesce(F.col("attack_type").cast("string"), F.lit("nan"))
    return df.groupBy(label.alias("attack_type")).agg(F.count("*").alias("packets"))


def report_payload(counts: DataFrame) -> DataFrame:
    """Metadata, summary and distribution as one row; the packets themselves stay a table."""
    types = counts.groupBy("attack_type").agg(F.sum("packets").alias("packets"))
    pairs = F.sort_array(F.collect_list(F.struct("attack_type", "packets")))
    distribution = types.agg(F.map_from_entries(pairs)).scalar()
    return traffic_distribution(counts).select(
        F.struct("total_packets", "anomalies").alias("metadata"),
        F.struct("normal", F.col("anomalies").alias("anomaly")).alias("summary"),
        distribution.alias("attack_distribution"),
    )


def preview(df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    """First rows in a stated order: a top-k per task, then among the tasks."""
    return df.orderBy(*order).limit(rows)


def event_lines(df: DataFrame, time: Column | None = None) -> DataFrame:
    """Text lines for anomalies: time, what was detected and the two addresses."""
    stamp = F.date_format(
        F.timestamp_micros(F.col("event_us")) if time is None else time, "yyyy-MM-dd HH:mm:ss"
    )

    def address(name: str) -> Column:
        if name not in df.columns:
            return F.lit("unknown")
        return F.coalesce(F.when(strip(F.col(name)) != "", F.col(name)), F.lit("unknown"))

    detail = attack_label(
        F.coalesce(F.col("attack_type"), F.lit("anomaly")),
        F.coalesce(F.col("attack_confidence"), F.lit(0.0)),
    )
    line = F.concat(
        stamp, F.lit(" | "), detail, F.lit(" | "), address("ip_src"), F.lit(" -> "), address("ip_dst")
    )
    return df.filter(F.col("is_anomaly") == 1).withColumn("line", line)
