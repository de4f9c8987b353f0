import pytest
from pyspark.sql import functions as F

from packetlens.sources import packets as P
from packetlens.sources.schemas import PACKET_FIELDS

A = "192.168.1.10\t10.0.0.1\t128\t1700000000.123\t0x0018\t6"
B = "10.0.0.1\t192.168.1.10\t256\t1700000000.456\t0x0002\t6"
UDP = "172.16.0.5\t8.8.8.8\t64\t1700000000.789\t\t17"


def test_fields_and_empty_field_stays_text(lines):
    rows = P.parse_packets(lines(A, B, UDP)).orderBy("frame_time_epoch").collect()
    assert len(rows) == 3
    assert rows[0].asDict() == {
        "ip_src": "192.168.1.10",
        "ip_dst": "10.0.0.1",
        "frame_len": "128",
        "frame_time_epoch": "1700000000.123",
        "tcp_flags": "0x0018",
        "ip_proto": "6",
    }
    assert rows[1].frame_len == "256"
    assert rows[2].tcp_flags == ""


@pytest.mark.parametrize("text", ["", "   ", "\t\t\t\t\t", " \t \t\t\t\t　", " "])
def test_blank_lines_are_neither_packets_nor_rejects(lines, text):
    assert P.parse_packets(lines(text)).count() == 0
    assert P.rejected_lines(lines(text)).count() == 0


def test_wrong_width_is_rejected_with_counts(lines):
    text = lines("1.1.1.1\t2.2.2.2", A, A + "\textra")
    assert P.parse_packets(text).count() == 1
    rejects = P.rejected_lines(text).orderBy("got_fields").collect()
    assert [(r.got_fields, r.expected_fields) for r in rejects] == [(2, 6), (7, 6)]


def test_line_ends_and_outer_tabs(lines):
    rows = P.parse_packets(lines(A + "\r", "\t10.0.0.1\t1\t2\t\t\r\n")).collect()
    assert {r.ip_proto for r in rows} == {"6", ""}
    assert {r.ip_src for r in rows} == {"192.168.1.10", ""}


def test_other_fields_and_empty_list_means_default(lines):
    two = P.parse_packets(lines("a\tb", "x"), ["ip.src", "eth.type"])
    assert two.columns == ["ip_src", "eth_type"] and two.count() == 1
    assert P.parse_packets(lines(A), []).columns == [f.replace(".", "_") for f in PACKET_FIELDS]


def test_one_field_lines(lines):
    assert {r.ip_src for r in P.parse_packets(lines("a", "b\tc", " "), ["ip.src"]).collect()} == {"a"}


def test_read_lines_from_files(spark, tmp_path):
    (tmp_path / "one.tsv").write_bytes((A + "\r\n\r\n" + B + "\n").encode())
    (tmp_path / "two.tsv").write_text(UDP + "\nbroken\n")
    text = P.read_lines(spark, str(tmp_path))
    assert P.parse_packets(text).count() == 3
    reject = P.rejected_lines(text, keep=["file_path"]).collect()
    assert len(reject) == 1 and reject[0].file_path.endswith("two.tsv")


def test_capture_window_counts_from_the_first_packet(spark):
    rows = [("100.0",), ("105.0",), ("110.0",), ("110.5",), ("",)]
    packets = spark.createDataFrame(rows, "frame_time_epoch string")
    assert P.capture_window(packets, 10).count() == 4
    for unbounded in (0, -1, None):
        assert P.capture_window(packets, unbounded).count() == 5


def test_web_traffic_and_own_predicate(spark):
    rows = [
        ("1.1.1.1", "6", "80", "5000"),
        ("1.1.1.1", "6", "5000", "443"),
        ("1.1.1.1", "17", "443", "443"),
        ("", "6", "80", "80"),
        ("1.1.1.1", "6", "22", "23"),
        ("1.1.1.1", "6", "", ""),
    ]
    packets = spark.createDataFrame(
        rows, "ip_src string, ip_proto string, tcp_srcport string, tcp_dstport string"
    )
    assert P.web_traffic(packets).count() == 2
    assert P.web_traffic(packets, "ip_proto = '17'").count() == 1
    with pytest.raises(ValueError, match="tcp_dstport"):
        P.web_traffic(packets.drop("tcp_dstport"))


def test_first_occurrence(spark):
    packets = spark.createDataFrame([("a,b,c",), ("d",), ("",)], "ip_src string")
    got = [r.ip_src for r in P.first_occurrence(packets, ["ip_src"]).collect()]
    assert got == ["a", "d", ""]


def test_parse_splits_each_line_once(spark, tmp_path):
    (tmp_path / "x.tsv").write_text(A + "\n")
    plan = P.parse_packets(P.read_lines(spark, str(tmp_path)))
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert physical.count("split(") == 1
    assert "Exchange" not in physical
    assert plan.agg(F.count("*")).first()[0] == 1
