import json
import os

import pytest
from pyspark.sql import functions as F

from packetlens.operators import report as R
from packetlens.operators.rules import flag_large_frames
from packetlens.plans import reporting

ROWS = [
    ("10.0.0.1", "10.0.1.1", 0, "normal", 1.0, 0.12),
    ("10.0.0.2", "10.0.1.2", 1, "DoS", 0.94, -0.33),
    ("10.0.0.3", "10.0.1.3", 0, None, 1.0, 0.09),
    ("10.0.0.4", "10.0.1.4", 1, "PortScan", 0.88, -0.41),
    ("10.0.0.5", "10.0.1.5", 0, "normal", 1.0, 0.11),
]
SCHEMA = (
    "ip_src string, ip_dst string, is_anomaly int, attack_type string, "
    "attack_confidence double, anomaly_score double"
)


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def counts(df):
    return R.outcome_counts(R.prepare_report(df))


def test_totals_distribution_and_shares(golden):
    assert tuple(R.traffic_distribution(counts(golden)).first()) == (5, 2, 3)
    distribution = [tuple(r) for r in R.attack_distribution(counts(golden)).collect()]
    assert distribution == [("normal", 2), ("DoS", 1), ("PortScan", 1), ("unknown", 1)]
    shares = {r.attack_type: r.percent for r in R.attack_share(counts(golden)).collect()}
    assert shares == {"normal": 40.0, "DoS": 20.0, "PortScan": 20.0, "unknown": 20.0}


def test_summary_counts_nulls_as_nan(golden):
    got = {r.attack_type: r.packets for r in R.attack_summary(golden).collect()}
    assert got == {"normal": 2, "DoS": 1, "PortScan": 1, "nan": 1}


def test_payload(golden):
    row = R.report_payload(counts(golden)).first()
    assert row.metadata.asDict() == {"total_packets": 5, "anomalies": 2}
    assert row.summary.asDict() == {"normal": 3, "anomaly": 2}
    assert row.attack_distribution == {"normal": 2, "DoS": 1, "PortScan": 1, "unknown": 1}


@pytest.mark.parametrize(
    "kind, values, flags",
    [
        ("boolean", [True, False, None], [1, 0, 0]),
        ("double", [1.0, 0.0, -1.0, 2.5, float("nan"), None], [1, 0, 1, 1, 0, 0]),
        ("bigint", [1, 0, 7, None], [1, 0, 1, 0]),
        ("string", ["1", " Yes\t", "ANOMALY", "1.0", "2", "", None], [1, 1, 1, 0, 0, 0, 0]),
    ],
)
def test_flags(spark, kind, values, flags):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, is_anomaly {kind}")
    assert [r.is_anomaly for r in R.normalize_flags(table).orderBy("i").collect()] == flags


def test_required_columns(golden):
    with pytest.raises(ValueError, match="attack_type"):
        R.prepare_report(golden.drop("attack_type"))
    with pytest.raises(ValueError, match="attack_type"):
        R.attack_summary(golden.drop("attack_type"))


def test_rule(spark):
    rows = [
        (1200.0, 0, "normal", 1.0), (1200.5, 0, "normal", 1.0), (1500.0, 1, "DoS", 0.7),
        (1500.0, None, "normal", 1.0), (None, 0, "normal", 1.0),
    ]
    table = spark.createDataFrame(
        rows, "frame_len double, is_anomaly int, attack_type string, attack_confidence double"
    )
    got = [tuple(r)[1:] for r in flag_large_frames(table).collect()]
    hit = (1, "suspicious_traffic", 0.9)
    assert got == [(0, "normal", 1.0), hit, (1, "DoS", 0.7), hit, (0, "normal", 1.0)]
    assert flag_large_frames(table.drop("frame_len")).columns == table.columns[1:]


def test_event_lines(spark):
    rows = [
        (1700000000123456, "1.1.1.1", "2.2.2.2", 1, "ddos", 0.925),
        (1700000001000000, "", None, 1, "Normal", 0.5),
        (1700000002000000, "1.1.1.1", "2.2.2.2", 0, "ddos", 0.9),
        (1700000003000000, "1.1.1.1", "2.2.2.2", 1, "", 0.9),
    ]
    table = spark.createDataFrame(
        rows,
        "event_us bigint, ip_src string, ip_dst string, is_anomaly int, attack_type string, "
        "attack_confidence double",
    )
    got = [r.line for r in R.event_lines(table).orderBy("event_us").collect()]
    assert got[0].startswith("2023-11-14 22:13:20 | [ANOMALY] ddos detected (confidence: 0.9")
    assert got[0].endswith(") | 1.1.1.1 -> 2.2.2.2")
    assert got[1] == "2023-11-14 22:13:21 | [ANOMALY] Anomaly detected | unknown -> unknown"
    assert got[2] == "2023-11-14 22:13:23 | [ANOMALY] Anomaly detected | 1.1.1.1 -> 2.2.2.2"


def test_two_reports_in_one_second(golden, tmp_path, monkeypatch):
    class Fixed(reporting.datetime):
        @classmethod
        def now(cls):
            return cls(2026, 1, 2, 3, 4, 5)

    monkeypatch.setattr(reporting, "datetime", Fixed)
    first, second = (reporting.generate_report(golden, str(tmp_path))["output_dir"] for _ in range(2))
    assert first != second and second.startswith(first)


def test_report_folder(spark, golden, tmp_path):
    paths = reporting.generate_report(golden, str(tmp_path), order=["ip_src"])
    assert os.path.dirname(paths["output_dir"]) == str(tmp_path)
    assert len(os.path.basename(paths["output_dir"])) == len("2026-04-06_21-23-55")
    assert spark.read.parquet(paths["data"]).count() == 5
    assert [r.ip_src for r in spark.read.parquet(paths["preview"]).collect()] == [r[0] for r in ROWS]
    summary = reporting.read_summary(spark, paths["summary"])
    assert summary["metadata"]["total_packets"] == 5 and summary["summary"] == {"normal": 3, "anomaly": 2}
    assert tuple(spark.read.parquet(paths["traffic"]).first()) == (5, 2, 3)
    assert spark.read.parquet(paths["attack_share"]).count() == 4


def test_json_results(spark, golden, tmp_path):
    path = reporting.results_to_json(golden, str(tmp_path / "r"))
    records = [json.loads(r.value) for r in spark.read.text(f"{path}/data").collect()]
    assert len(records) == 5
    assert {"ip.src": "10.0.0.3", "ip.dst": "10.0.1.3", "is_anomaly": 0, "attack_type": "unknown",
            "attack_confidence": 1.0, "anomaly_score": 0.09} in records
    assert reporting.read_summary(spark, f"{path}/summary")["attack_distribution"]["normal"] == 2


def test_empty_input_is_an_error(golden, tmp_path):
    none = golden.filter("is_anomaly > 1")
    with pytest.raises(ValueError, match="empty"):
        reporting.generate_report(none, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="empty"):
        reporting.results_to_json(none, str(tmp_path / "b"))


def test_preview_is_ten_rows_in_order(spark):
    table = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("n"))
    preview = R.preview(table, ["n"])
    assert [r.n for r in preview.collect()] == list(range(1, 11))
    assert "TakeOrderedAndProject" in preview._jdf.queryExecution().executedPlan().toString()
