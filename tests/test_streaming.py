import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.models import FlagClassifier, frozen_forest
from packetlens.operators import alerts as A
from packetlens.operators import report as R
from packetlens.plans import analysis
from packetlens.sources import packets as P
from packetlens.sources.schemas import PACKET_FEATURES, PACKET_FIELDS
from packetlens.streaming import alerts as SA
from packetlens.streaming import realtime as RT

NOW = {"availableNow": True}
LIMITS = {"anomaly": (10_000_000, 5), "traffic": (1_000_000, 20)}


def capture(path, start, count, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        at = start + rng.random() * 20
        length, flags = rng.choice([60, 700, 1400]), rng.choice(["0x0002", "0x0010", ""])
        rows.append(f"10.0.0.{i % 9}\t10.1.0.1\t{length}\t{at:.6f}\t{flags}\t{rng.choice([6, 17])}")
    with open(path, "w") as f:
        f.write("\n".join([*rows, "broken\tline", ""]) + "\n")


def keyed(df):
    return sorted((r.sensor, r.kind, r.event_us, r.rn, r["count"], r.message) for r in df.collect())


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        capture(folder / f"f{i}.tsv", 1_700_000_000 + 20 * i, 300, seed=i)
        time.sleep(0.02)
    return str(folder)


def test_stream_parse_equals_batch(spark, source, tmp_path):
    out = str(tmp_path / "out")
    RT.append_table(RT.stream_packets(spark, source, max_files=1), out, NOW).awaitTermination()
    batch = P.parse_packets(P.read_lines(spark, source))
    got = spark.read.parquet(out)
    assert got.count() == 1200 and got.exceptAll(batch).count() == 0


def test_realtime_job_equals_batch(spark, source, tmp_path):
    paths = RT.run_realtime(
        spark, source, str(tmp_path / "rt"), frozen_forest(), FlagClassifier(), limits=LIMITS,
        max_files=2, report_base=str(tmp_path / "reports"),
    )
    packets = P.parse_packets(P.read_lines(spark, source))
    batch = RT.realtime_results(packets, frozen_forest(), FlagClassifier())
    results = spark.read.parquet(paths["results"])
    assert results.count() == 1200 and results.exceptAll(batch).count() == 0
    found = spark.read.schema(A.ALERT_SCHEMA).parquet(paths["alerts"])
    want = keyed(A.find_alerts(A.instants(batch), LIMITS))
    assert len(want) > 20 and keyed(found) == want
    assert spark.read.parquet(paths["data"]).count() == 1200
    lines = spark.read.parquet(paths["event_lines"])
    assert lines.count() == batch.filter("is_anomaly = 1").count()
    assert lines.filter("line not like '% | [ANOMALY] %'").count() == 0


def test_realtime_job_takes_the_web_predicate_and_writes_by_day(spark, tmp_path):
    folder, day = tmp_path / "in", 86_400
    folder.mkdir()
    rows = [(0, 6, 80, 5000), (day, 6, 6000, 443), (day + 1, 6, 22, 5000), (day + 2, 17, 443, 443), (day + 3, 6, 443, 1)]
    text = [f"10.0.0.1\t10.1.0.1\t1400\t{1_700_006_400 + t}\t0x0002\t{p}\t{a}\t{b}" for t, p, a, b in rows]
    (folder / "a.tsv").write_text("\n".join(text) + "\n")
    paths = RT.run_realtime(
        spark, str(folder), str(tmp_path / "rt"), frozen_forest(), FlagClassifier(), limits=LIMITS,
        fields=[*PACKET_FIELDS, "tcp.srcport", "tcp.dstport"], predicate=P.is_web_packet(), by_day=True,
        report_base=str(tmp_path / "reports"),
    )
    days = spark.read.parquet(paths["results"]).groupBy("capture_date").count()
    assert sorted((str(r.capture_date), r["count"]) for r in days.collect()) == [("2023-11-15", 1), ("2023-11-16", 2)]
    assert {n for n in os.listdir(paths["results"]) if "=" in n} == {"capture_date=2023-11-15", "capture_date=2023-11-16"}
    assert "capture_date" not in spark.read.parquet(paths["preview"]).columns
    assert spark.read.parquet(paths["traffic"]).first().total_packets == 3


def test_empty_source_makes_no_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.tsv").write_text("\nbroken\n")
    paths = RT.run_realtime(
        spark, str(tmp_path / "in"), str(tmp_path / "rt"), frozen_forest(), FlagClassifier(),
        report_base=str(tmp_path / "reports"),
    )
    assert "data" not in paths and not os.path.exists(tmp_path / "reports")
    rejects = spark.read.parquet(paths["rejects"]).collect()
    assert [(r.value, r.got_fields, r.expected_fields) for r in rejects] == [("broken", 1, 6)]


def flagged(spark, folder, max_files=None):
    lines = P.stream_lines(spark, folder, max_files) if max_files else P.read_lines(spark, folder)
    from packetlens.operators.features import packet_features

    table = packet_features(P.parse_packets(lines), keep=["event_us"])
    return table.withColumn("is_anomaly", (F.col("frame_len") > 1200).cast("int"))


def alert_paths(tmp_path):
    return {name: str(tmp_path / name) for name in ("instants", "alerts", "alert_state")}


def follow(spark, packets, paths, **options):
    query = SA.follow_alerts(SA.stream_instants(packets, **options), paths, NOW, LIMITS)
    query.awaitTermination()
    return query


def closed(spark, paths):
    return spark.read.schema(SA.INSTANT_SCHEMA).parquet(paths["instants"])


def test_alert_state_lives_across_batches_and_restarts(spark, source, tmp_path):
    paths = alert_paths(tmp_path)
    before = spark.conf.get(SA._PROVIDER)
    follow(spark, flagged(spark, source, 2), paths, delay="1 second")
    assert spark.conf.get(SA._PROVIDER) == before
    early = spark.read.schema(A.ALERT_SCHEMA).parquet(paths["alerts"]).count()
    capture(os.path.join(source, "f9.tsv"), 1_700_000_080, 300, seed=9)
    follow(spark, flagged(spark, source, 2), paths, delay="1 second")
    # Blocks that are still open count as far as they have come, and only once.
    for _ in range(2):
        got = keyed(SA.close_alerts(spark, paths, LIMITS))
        want = keyed(A.find_alerts(A.instants(flagged(spark, source)), LIMITS))
        assert got == want and 0 < early < len(want)
    held = SA.open_instants(spark, paths).agg(F.sum("packets")).first()[0]
    sent = closed(spark, paths).filter("not late").agg(F.sum("packets")).first()[0]
    assert held > 0 and held + sent == 1500


def test_a_batch_that_runs_again_changes_nothing(spark, source, tmp_path):
    paths = alert_paths(tmp_path)
    follow(spark, flagged(spark, source, 2), paths, delay="1 second")
    want = keyed(SA.close_alerts(spark, paths, LIMITS))
    # As after a crash between the tables' writing and the commit of the last batch.
    commits = sorted((tmp_path / "instants_checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (commits[-1].parent / f".{commits[-1].name}.crc").rename(tmp_path / "sum")
    commits[-1].rename(tmp_path / "uncommitted")
    follow(spark, flagged(spark, source, 2), paths, delay="1 second")
    assert keyed(SA.close_alerts(spark, paths, LIMITS)) == want


def test_late_packets_are_kept_apart(spark, tmp_path):
    folder, paths = tmp_path / "in", alert_paths(tmp_path)
    folder.mkdir()
    capture(folder / "a.tsv", 1_700_000_100, 50)
    follow(spark, flagged(spark, str(folder), 10), paths, delay="1 second")
    want = keyed(SA.close_alerts(spark, paths, LIMITS))
    capture(folder / "late.tsv", 1_700_000_000, 50, seed=1)
    follow(spark, flagged(spark, str(folder), 10), paths, delay="1 second")
    (row,) = SA.late_packets(spark, paths).collect()
    late = flagged(spark, str(folder / "late.tsv"))
    assert (row.late_packets, row.late_anomalies) == (50, late.filter("is_anomaly = 1").count())
    held = SA.open_instants(spark, paths).agg(F.sum("packets")).first()[0] or 0
    assert row.late_packets + row.closed_packets + held == 100
    # They raise no alerts.
    assert keyed(SA.close_alerts(spark, paths, LIMITS)) == want


def test_one_sensor_and_block_are_many_keys(spark, tmp_path):
    folder, paths = tmp_path / "in", alert_paths(tmp_path)
    folder.mkdir()
    capture(folder / "a.tsv", 1_700_000_000, 2000)
    follow(spark, flagged(spark, str(folder), 10), paths, delay="1000 seconds")
    state = spark.read.format("statestore").option("stateVarName", "instants")
    with SA._state_store(spark):
        keys = state.load(f"{paths['instants']}_checkpoint").groupBy("key").count().collect()
    assert len(keys) >= 2 * SA.SHARES and max(r["count"] for r in keys) < 2000 / SA.SHARES


def test_what_arrives_at_once_is_one_entry_of_its_key(spark, tmp_path):
    folder, paths = tmp_path / "in", alert_paths(tmp_path)
    folder.mkdir()
    capture(folder / "a.tsv", 1_700_000_000, 2000)
    follow(spark, flagged(spark, str(folder), 10), paths, delay="1000 seconds")
    state = spark.read.format("statestore").option("stateVarName", "instants")
    with SA._state_store(spark):
        keys = state.load(f"{paths['instants']}_checkpoint").groupBy("key").count().collect()
    assert {r["count"] for r in keys} == {1}
    columns = ["sensor", "event_us", "packets", "anomalies"]
    want = A.instants(flagged(spark, str(folder))).select(*columns).collect()
    assert sorted(SA.open_instants(spark, paths).select(*columns).collect()) == sorted(want)


def test_entries_are_cut_to_size(monkeypatch):
    monkeypatch.setattr(SA, "ENTRY_INSTANTS", 10)
    sums = pd.DataFrame({"event_us": range(25), "packets": 1, "anomalies": range(25)})
    entries = SA._entries(sums)
    assert [len(us) for us, _, _ in entries] == [10, 10, 5]
    assert entries[2] == ([*range(20, 25)], [1] * 5, [*range(20, 25)])


def test_arrival_time_instead_of_capture_time(spark, source, tmp_path):
    paths = alert_paths(tmp_path)
    follow(spark, flagged(spark, source, 10), paths, time=F.current_timestamp())
    held = SA.open_instants(spark, paths).collect()
    assert [r.packets for r in held] == [1200]


def test_endless_job(spark, source, tmp_path):
    base = str(tmp_path / "rt")
    queries = RT.start_realtime(
        spark, source, base, frozen_forest(), FlagClassifier(), limits=LIMITS, interval="1 second",
        delay_seconds=1,
    )
    try:
        for _ in range(3):
            for query in queries:
                query.processAllAvailable()
        assert spark.read.parquet(f"{base}/results").count() == 1200
        assert spark.read.parquet(f"{base}/event_lines").count() > 0
        assert spark.read.parquet(f"{base}/alerts").count() > 0
    finally:
        for query in queries:
            query.stop()


def test_progress_is_observed_per_batch(spark, source, tmp_path):
    packets = RT.with_progress(RT.stream_packets(spark, source, max_files=1))
    query = RT.append_table(packets, str(tmp_path / "out"), NOW)
    query.awaitTermination()
    sizes = [p["observedMetrics"]["progress"]["packets"] for p in query.recentProgress]
    assert sum(sizes) == 1200


@pytest.mark.parametrize(
    "sizes, marks",
    [([1] * 120, [(49, 50), (99, 100)]), ([30, 30, 40, 0], [(1, 50), (2, 100)]), ([170], [(0, 50), (0, 100), (0, 150)])],
)
def test_a_mark_for_each_fifty_packets(spark, sizes, marks):
    counts = spark.createDataFrame(list(enumerate(sizes)), "batch int, packets bigint")
    assert sorted(map(tuple, RT.progress_marks(counts).collect())) == marks


def test_outcomes_are_kept_by_batch_and_replaced(spark, source, tmp_path):
    out = str(tmp_path / "counts")
    results = RT.realtime_results(
        RT.stream_packets(spark, source, max_files=2), frozen_forest(), FlagClassifier()
    )
    for attempt in ("a", "b"):  # each goes through the same batches from the start
        query = RT.append_outcomes(results, out, NOW, checkpoint=str(tmp_path / attempt))
        query.awaitTermination()
        assert RT.batch_counts(spark, out).agg({"packets": "sum"}).first()[0] == 1200
    batch = RT.realtime_results(P.parse_packets(P.read_lines(spark, source)), frozen_forest(), FlagClassifier())
    want = sorted(map(tuple, R.outcome_counts(R.prepare_report(batch)).collect()))
    assert sorted(map(tuple, RT.running_outcomes(spark, out).collect())) == want
    assert spark.read.parquet(f"{out}_first").count() == 20


def _capture(folder, times, name):
    folder.mkdir(exist_ok=True)
    rows = [f"10.0.0.1\t10.0.0.2\t1500\t{t}\t0x02\t6" for t in times]
    (folder / name).write_text("\n".join(rows) + "\n")


def test_packets_without_or_with_wrong_time_reach_the_alerts(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "out")
    first = [f"1700000000.{i:03d}" for i in range(300)] + [""] * 100 + ["99999999999"]
    _capture(source, first, "a.tsv")
    model = (frozen_forest(), FlagClassifier())
    paths = RT.run_realtime(spark, str(source), base, *model)
    held = SA.open_instants(spark, paths).agg(F.sum("packets")).first()[0]
    sent = closed(spark, paths).agg(F.sum("packets")).first()[0] or 0
    assert held + sent == 401
    assert spark.read.parquet(paths["results"]).count() == 401


def test_a_second_run_goes_on_where_the_first_ended(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "out")
    model = (frozen_forest(), FlagClassifier())
    _capture(source, [f"1700000000.{i:03d}" for i in range(300)], "a.tsv")
    paths = RT.run_realtime(spark, str(source), base, *model)
    _capture(source, [f"1700000000.{i:03d}" for i in range(300, 600)], "b.tsv")
    RT.run_realtime(spark, str(source), base, *model)
    packets = P.parse_packets(P.read_lines(spark, str(source)))
    batch = RT.realtime_results(packets, *model)
    want = keyed(A.find_alerts(A.instants(batch)))
    assert want and keyed(spark.read.schema(A.ALERT_SCHEMA).parquet(paths["alerts"])) == want


def test_predicate_and_fields_in_the_job(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "out")
    _capture(source, ["1700000000.1", "1700000000.2", ""], "a.tsv")
    paths = RT.run_realtime(
        spark, str(source), base, frozen_forest(), FlagClassifier(), predicate="frame_time_epoch <> ''"
    )
    assert spark.read.parquet(paths["results"]).count() == 2


def test_batch_job(spark, source, tmp_path):
    from packetlens.operators.classify import fit_classifier

    packets = P.parse_packets(P.read_lines(spark, source))
    result = analysis.analyze_packets(packets, frozen_forest(), FlagClassifier())
    detector = frozen_forest().save(spark, str(tmp_path / "d"))
    truth = result.filter("is_anomaly = 1")
    model = fit_classifier(truth, PACKET_FEATURES, path=str(tmp_path / "c"), trees=8, max_depth=5)
    paths = analysis.run_batch(spark, source, detector, model.path, str(tmp_path / "reports"))
    got = spark.read.parquet(paths["data"])
    assert got.count() == 1200
    assert got.filter("is_anomaly = 1").count() == truth.count()
    assert spark.read.parquet(paths["preview"]).count() == 10
    ledger = {r.outcome: r.rows for r in spark.read.parquet(paths["quality"]).collect()}
    lines = P.read_lines(spark, source).count()
    assert ledger == {"read": lines, "blank": lines - 1204, "packets": 1200, "rejected": 4}
    short = analysis.run_batch(
        spark, source, detector, model.path, str(tmp_path / "short"), seconds=10, schema=["flow_duration"]
    )
    seen = spark.read.parquet(short["data"])
    assert 0 < seen.count() < 300 and seen.filter("is_anomaly <> 0").count() == 0
    with pytest.raises(ValueError, match="empty"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.tsv").write_text("\n")
        analysis.run_batch(spark, str(tmp_path / "none"), detector, model.path, str(tmp_path / "r"))
