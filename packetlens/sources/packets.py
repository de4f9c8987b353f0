"""Capture text as packets: batch and streaming scans, parsing, rejects and capture bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packets import TCP
from ..functions.text import SPACE, is_blank, number_or_zero
from .schemas import PACKET_FIELDS, field_column, require_columns

# Ports of the default capture predicate.
WEB_PORTS = [80, 443]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line of TAB-separated capture exports, with the file it came from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same rows from a folder that capture exports keep arriving in."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))


def _split(line: Column) -> Column:
    return F.split(F.rtrim(line, F.lit("\r\n")), "\t", -1)


def _line_pattern(width: int) -> str:
    """Lines of ``width`` fields that are not blank.

    A filter on the size of the split would make Catalyst split every line twice.
    """
    return rf"(?s)^(?={SPACE}*+.)[^\t]*+(?:\t[^\t]*+){{{width - 1}}}\z"


def fits(line: Column, fields: Sequence[str] | None = None) -> Column:
    """Whether a line is a packet: not blank, and as wide as ``fields``."""
    return line.rlike(_line_pattern(len(fields or PACKET_FIELDS)))


def parse_packets(
    lines: DataFrame, fields: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Packets of STRING fields from ``value``; blank lines and lines of another width are left out.

    Empty fields stay empty text. ``keep`` names further input columns to carry along. The same
    expression serves batch and streaming input, and nothing is shuffled.
    """
    fields = list(fields or PACKET_FIELDS)
    parts = lines.filter(fits(F.col("value"), fields)).select(
        *keep, _split(F.col("value")).alias("_parts")
    )
    return parts.select(
        *keep, *[F.col("_parts")[i].alias(field_column(f)) for i, f in enumerate(fields)]
    )


def rejected_lines(
    lines: DataFrame, fields: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Lines that are neither blank nor as wide as ``fields``, with both widths."""
    expected = len(fields or PACKET_FIELDS)
    return (
        lines.filter(~is_blank(F.col("value")))
        .withColumn("got_fields", F.size(_split(F.col("value"))))
        .withColumn("expected_fields", F.lit(expected))
        .filter(F.col("got_fields") != expected)
        .select(*keep, "value", "got_fields", "expected_fields")
    )


def select_fields(
    packets: DataFrame, fields: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Only the listed capture fields, in order; an empty list counts as not given."""
    names = [field_column(f) for f in (fields or PACKET_FIELDS)]
    require_columns(packets, names)
    return packets.select(*keep, *names)


def first_occurrence(packets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First value of fields that the export repeats as a comma list."""
    return packets.withColumns({c: F.split(F.col(c), ",", 2)[0] for c in columns})


def is_web_packet() -> Column:
    """Whether a packet is IPv4 with TCP port 80 or 443 at either end; jobs take it as ``predicate``."""
    ports = [
        number_or_zero(F.col(c).cast("string")).isin([float(p) for p in WEB_PORTS])
        for c in ("tcp_srcport", "tcp_dstport")
    ]
    is_tcp = number_or_zero(F.col("ip_proto").cast("string")) == TCP
    return (F.col("ip_src") != "") & is_tcp & (ports[0] | ports[1])


def web_traffic(packets: DataFrame, predicate: str | None = None) -> DataFrame:
    """Packets that ``is_web_packet``, or those of another SQL predicate."""
    if predicate:
        return packets.filter(predicate)
    require_columns(packets, ["ip_src", "ip_proto", "tcp_srcport", "tcp_dstport"])
    return packets.filter(is_web_packet())


def capture_window(packets: DataFrame, seconds: float | None) -> DataFrame:
    """Packets of the first ``seconds`` of the capture; no bound unless ``seconds`` is positive.

    The start is a scalar subquery over one pruned column, so the packets are not shuffled.
    """
    if not seconds or seconds <= 0:
        return packets
    epoch = number_or_zero(F.col("frame_time_epoch"))
    start = packets.agg(F.min(F.when(epoch > 0, epoch))).scalar()
    return packets.filter(epoch <= start + F.lit(float(seconds)))
