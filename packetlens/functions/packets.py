"""Expressions on single packet fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# TCP header flag bits.
TCP_FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10}

# IP protocol numbers.
TCP, UDP = 6, 17

# Last second that still fits a signed 64-bit count of nanoseconds.
_LAST_SECOND = 9223372036.85

_HEX = rf"^{SPACE}*(?:0[xX])?([0-9a-fA-F]{{1,15}}){SPACE}*$"


def tcp_flag_mask(c: Column) -> Column:
    """Hex text such as ``0x0018`` to a BIGINT bit mask; blank, null and bad text give 0."""
    digits = F.regexp_extract(c, _HEX, 1)
    return F.coalesce(F.conv(digits, 16, 10).try_cast("bigint"), F.lit(0).cast("bigint"))


def has_flag(mask: Column, name: str) -> Column:
    return (mask.bitwiseAND(F.lit(TCP_FLAG_BITS[name])) != 0).cast("int")


def hour_of_day(epoch: Column) -> Column:
    """UTC hour of a DOUBLE epoch in seconds, rounded to nanoseconds first; 0 when out of range."""
    hour = F.pmod(F.floor((epoch + 5e-10) / 3600), F.lit(24)).cast("int")
    return F.when(F.abs(epoch) <= _LAST_SECOND, hour).otherwise(0)


def epoch_micros(epoch: Column) -> Column:
    """DOUBLE epoch seconds to BIGINT microseconds; 0 when out of range."""
    micros = F.when(F.abs(epoch) <= _LAST_SECOND, F.floor(epoch * 1000000 + 0.5))
    # Never null, so that a join on it adds no null check that would parse the lines once more.
    return F.coalesce(micros, F.lit(0).cast("bigint"))
