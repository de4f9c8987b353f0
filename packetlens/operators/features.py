"""Packet fields to model features. One projection after Catalyst collapses the steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packets import TCP, TCP_FLAG_BITS, UDP, epoch_micros, has_flag, hour_of_day, tcp_flag_mask
from ..functions.text import number_or_zero
from ..sources.schemas import ADDRESSES, PACKET_FEATURES

NUMERIC_FIELDS = ["frame_len", "frame_time_epoch", "ip_proto"]


def cast_numeric(packets: DataFrame) -> DataFrame:
    """Length, time and protocol as DOUBLE, where present; what is not a number becomes 0."""
    present = [c for c in NUMERIC_FIELDS if c in packets.columns]
    return packets.withColumns({c: number_or_zero(F.col(c)) for c in present})


def add_features(packets: DataFrame) -> DataFrame:
    """Protocol one-hots, flag bits, hour and event time, from numeric packet fields."""
    flags = packets.withColumn("_mask", tcp_flag_mask(F.col("tcp_flags")))
    columns = {
        "is_tcp": (F.col("ip_proto") == TCP).cast("int"),
        "is_udp": (F.col("ip_proto") == UDP).cast("int"),
        "hour_of_day": hour_of_day(F.col("frame_time_epoch")),
        "event_us": epoch_micros(F.col("frame_time_epoch")),
    }
    columns |= {f"tcp_flag_{n}": has_flag(F.col("_mask"), n) for n in TCP_FLAG_BITS}
    return flags.withColumns(columns).drop("_mask")


def select_features(
    df: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Addresses and the wanted features; names that ``df`` lacks are skipped."""
    wanted = [*keep, *ADDRESSES, *(features or PACKET_FEATURES)]
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def packet_features(
    packets: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Parsed packets to the feature table."""
    return (
        packets.transform(cast_numeric)
        .transform(add_features)
        .transform(select_features, features, keep)
    )
