import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from packetlens.functions.packets import TCP_FLAG_BITS, has_flag, hour_of_day, tcp_flag_mask
from packetlens.functions.text import number_or_zero, strip
from packetlens.operators.features import cast_numeric, packet_features, select_features
from packetlens.sources.packets import parse_packets
from packetlens.sources.schemas import PACKET_FEATURES

GOLDEN = [
    "192.168.1.10\t10.0.0.1\t128\t1700000000.123\t0x0018\t6",
    "10.0.0.1\t192.168.1.10\t256\t1700000000.456\t0x0002\t6",
    "172.16.0.5\t8.8.8.8\t64\t1700000000.789\t\t17",
]


def values(spark, texts, expression, kind="string"):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    rows = table.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_golden_packets(lines):
    table = packet_features(parse_packets(lines(*GOLDEN)))
    assert table.columns == ["ip_src", "ip_dst", *PACKET_FEATURES]
    rows = {r.frame_len: r for r in table.collect()}
    flags = ["tcp_flag_syn", "tcp_flag_ack", "tcp_flag_fin", "tcp_flag_rst", "tcp_flag_psh"]
    expected = {
        128.0: (6.0, 1, 0, [0, 1, 0, 0, 1]),
        256.0: (6.0, 1, 0, [1, 0, 0, 0, 0]),
        64.0: (17.0, 0, 1, [0, 0, 0, 0, 0]),
    }
    for length, (proto, tcp, udp, bits) in expected.items():
        r = rows[length]
        assert (r.ip_proto, r.is_tcp, r.is_udp, [r[f] for f in flags]) == (proto, tcp, udp, bits)
        assert r.hour_of_day == 22


def test_numbers(spark):
    cases = {
        "": 0.0, " 12 ": 12.0, "1e3": 1000.0, "+5": 5.0, "12.": 12.0, ".5": 0.5, "-7.25": -7.25,
        "0x1F": 0.0, "0x1p3": 0.0, "1_000": 0.0, "1,000": 0.0, "True": 0.0, "nan": 0.0, "NaN": 0.0,
        "5d": 0.0, "5.f": 0.0, "1e3D ": 0.0, "abc": 0.0, "inf": math.inf, "-Infinity": -math.inf,
        "+inf": math.inf,
    }
    assert values(spark, list(cases), number_or_zero) == list(cases.values())
    assert values(spark, [None], number_or_zero) == [0.0]


def test_flag_texts(spark):
    cases = {
        "0x0018": 24, "0x0002": 2, "": 0, "not_a_number": 0, "18": 24, " 0X1f\t": 31, "0x": 0,
        "ff": 255, "-0x2": 0, "0xzz": 0,
    }
    assert values(spark, list(cases), tcp_flag_mask) == list(cases.values())
    assert values(spark, [None], tcp_flag_mask) == [0]


def test_each_flag_bit(spark):
    for name, bit in TCP_FLAG_BITS.items():
        assert values(spark, [bit, 0x1F & ~bit], lambda c: has_flag(c, name), "bigint") == [1, 0]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_hour_is_utc_whatever_the_session(spark, zone):
    times = [0.0, 3599.0, 3599.9999999999, 3600.0, 86399.5, 1700000000.123, -1.0, math.inf, 1e20]
    expected = [0, 0, 1, 1, 23, 22, 23, 0, 0]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert values(spark, times, hour_of_day, "double") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hour_agrees_with_the_calendar(spark):
    times = [float(t) for t in range(-200_000, 400_000, 7_919)]
    want = [datetime.fromtimestamp(t, timezone.utc).hour for t in times]
    assert values(spark, times, hour_of_day, "double") == want


def test_blank_packet_is_all_zero(lines):
    row = packet_features(parse_packets(lines("1.1.1.1\t2.2.2.2\t\t\t\t")), keep=["event_us"]).first()
    assert (row.frame_len, row.ip_proto, row.hour_of_day, row.event_us) == (0.0, 0.0, 0, 0)


def test_event_time_to_the_microsecond(lines):
    row = packet_features(parse_packets(lines(GOLDEN[0])), keep=["event_us"]).first()
    assert row.event_us == 1700000000123000


def test_cast_skips_absent_columns(spark):
    table = spark.createDataFrame([("7",)], "frame_len string")
    assert cast_numeric(table).first().frame_len == 7.0


def test_select_skips_absent_features(lines):
    table = packet_features(parse_packets(lines(GOLDEN[0])), ["frame_len", "nothing"])
    assert table.columns == ["ip_src", "ip_dst", "frame_len"]
    assert select_features(table.drop("ip_dst")).columns == ["ip_src", "frame_len"]


def test_strip_removes_what_python_strips(spark):
    texts = [" x　", "\t\r\n x \x1f", "x", "", "   "]
    assert values(spark, texts, strip) == [t.strip() for t in texts]
