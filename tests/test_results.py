import os
import uuid

import pytest
from pyspark.sql import functions as F

from packetlens.plans import reporting, results
from packetlens.sources import workspace

DAY = 86_400_000_000


def packets(spark, *rows):
    table = spark.createDataFrame(rows, "event_us bigint, ip_src string, is_anomaly int")
    label = F.when(F.col("is_anomaly") == 1, "ddos").otherwise("normal")
    return table.withColumn("attack_type", label)


def seen(df):
    return sorted((str(r.capture_date), r.ip_src, r.is_anomaly) for r in df.collect())


def test_a_run_replaces_its_days_and_no_others(spark, tmp_path):
    path = str(tmp_path / "t")
    first = results.write_results(packets(spark, (5, "a", 0), (DAY, "b", 1), (DAY + 9, "c", 0)), path)
    second = results.write_results(packets(spark, (DAY + 3, "b", 0), (2 * DAY, "d", 1)), path)
    want = [("1970-01-01", "a", 0), ("1970-01-02", "b", 0), ("1970-01-03", "d", 1)]
    assert seen(results.read_results(spark, path)) == want
    assert seen(results.read_results(spark, path, "1970-01-02", "1970-01-02")) == want[1:2]
    assert results.run_results(spark, path, first).count() == 1
    assert results.run_results(spark, path, second).count() == 2
    days = {str(r.capture_date): (r.packets, r.anomalies) for r in results.daily_counts(spark, path).collect()}
    assert days == {"1970-01-01": (1, 0), "1970-01-02": (1, 0), "1970-01-03": (1, 1)}


def test_packets_without_a_time_have_a_day(spark, tmp_path):
    path = str(tmp_path / "t")
    results.write_results(packets(spark, (None, "a", 0), (-7, "b", 0), (0, "c", None)), path)
    assert [r[0] for r in seen(results.read_results(spark, path))] == ["1970-01-01"] * 3


def test_rows_of_an_unfinished_run_are_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    results.write_results(packets(spark, (5, "a", 0), (DAY, "b", 1)), path)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(results, "run_results", fails)
        with pytest.raises(RuntimeError):
            results.write_results(packets(spark, (DAY, "x", 0)), path)
    assert seen(results.read_results(spark, path)) == [("1970-01-01", "a", 0)]
    results.write_results(packets(spark, (DAY, "x", 0)), path)
    assert seen(results.read_results(spark, path)) == [("1970-01-01", "a", 0), ("1970-01-02", "x", 0)]


def test_days_reach_the_scan_as_partition_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    results.write_results(packets(spark, (5, "a", 0), (DAY, "b", 1)), path)
    plan = results.read_results(spark, path, first="1970-01-02")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "/data" in line)
    assert "capture_date" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_nothing_is_shuffled_to_write(spark, tmp_path):
    dated = packets(spark, (5, "a", 0)).withColumn("d", results.capture_day())
    assert "Exchange" not in dated._jdf.queryExecution().executedPlan().toString()


def test_report_of_a_run_counts_its_own_rows(spark, tmp_path):
    table, base = str(tmp_path / "t"), str(tmp_path / "reports")
    results.write_results(packets(spark, (5, "a", 1)), table)
    paths = reporting.generate_report(packets(spark, (DAY, "b", 1), (DAY, "c", 0)), base, results=table)
    assert "data" not in paths and paths["results"] == table
    assert tuple(spark.read.parquet(paths["traffic"]).first()) == (2, 1, 1)
    assert spark.read.parquet(paths["preview"]).columns == ["event_us", "ip_src", "is_anomaly", "attack_type"]
    assert results.read_results(spark, table).count() == 3


def folders(base):
    return sorted(os.listdir(base)) if os.path.exists(base) else []


@pytest.fixture
def shared(tmp_path, monkeypatch):
    """The folder that new tables go to, whichever the session names."""
    base = str(tmp_path / "shared")
    monkeypatch.setattr(workspace, "new_folder", lambda spark, purpose: f"{base}/{purpose}-{uuid.uuid4().hex}")
    return base


def test_a_job_leaves_no_tables_behind(spark, shared):
    with workspace.job_workspace(spark):
        with workspace.job_workspace(spark):  # a job within a job
            inner = workspace.materialize(spark.range(3), "inner")
        assert inner.count() == 3 and len(folders(shared)) == 1
    assert folders(shared) == []
    with pytest.raises(RuntimeError), workspace.job_workspace(spark):
        workspace.materialize(spark.range(3), "inner")
        raise RuntimeError("failed")
    assert folders(shared) == []
    # Outside of jobs tables stay: what reads them may be used at any time.
    assert workspace.materialize(spark.range(3), "kept").count() == 3 and len(folders(shared)) == 1


def test_json_results_leave_no_tables_behind(spark, shared, tmp_path):
    reporting.results_to_json(packets(spark, (5, "a", 1)), str(tmp_path / "json"))
    assert folders(shared) == []
