import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from packetlens.operators import alerts as A
from packetlens.sources.workspace import materialize


def plain_fold(times, window_us, k):
    """The rule event by event."""
    window, fired = deque(), []
    for rn, now in enumerate(times, start=1):
        window.append(now)
        while window[0] < now - window_us:
            window.popleft()
        if len(window) > k:
            fired.append((now, rn))
            window.clear()
    return fired


def alerts_of(spark, rows, limits):
    packets = spark.createDataFrame(rows, "sensor string, event_us bigint, is_anomaly int")
    points = A.instants(packets, F.col("sensor"))
    found = A.find_alerts(points, limits).collect()
    return {
        kind: sorted((r.sensor, r.event_us, r.rn) for r in found if r.kind == kind) for kind in limits
    }


def expected(rows, limits):
    result = {}
    for kind, (window, k) in limits.items():
        fired = []
        for sensor in {r[0] for r in rows}:
            times = sorted(t for s, t, f in rows if s == sensor and (f or kind == "traffic"))
            fired += [(sensor, t, rn) for t, rn in plain_fold(times, window, k)]
        result[kind] = sorted(fired)
    return result


def second(*at):
    return [("s", int(t * 1e6), 1) for t in at]


def test_sixth_anomaly_fires_and_resets(spark):
    limits = {"anomaly": A.alert_limits()["anomaly"]}
    rows = second(*range(1000, 1006), *range(1020, 1025))
    assert alerts_of(spark, rows, limits) == {"anomaly": [("s", 1005_000_000, 6)]}


def test_traffic_spike_fires_and_resets(spark):
    limits = {"traffic": A.alert_limits()["traffic"]}
    rows = second(*[2000.0] * 201, *[2002.0] * 200)
    assert alerts_of(spark, rows, limits) == {"traffic": [("s", 2000_000_000, 201)]}


def test_window_is_closed(spark):
    limits = {"anomaly": (10_000_000, 1)}
    assert alerts_of(spark, second(0, 10), limits)["anomaly"] == [("s", 10_000_000, 2)]
    assert alerts_of(spark, second(0, 10.000001), limits)["anomaly"] == []


def test_messages_and_count(spark):
    packets = spark.createDataFrame(second(*[1] * 6), "sensor string, event_us bigint, is_anomaly int")
    row = A.find_alerts(A.instants(packets), {"anomaly": (10_000_000, 5)}).first()
    assert (row.sensor, row["count"], row.message) == ("all", 6, A.MESSAGES["anomaly"])


@pytest.mark.parametrize("seed", range(4))
def test_random_cases(spark, seed):
    rng = random.Random(seed)
    limits = {
        "anomaly": (rng.choice([0, 400_000, 2_000_000, 25_000_000]), rng.choice([0, 1, 5])),
        "traffic": (rng.choice([1_000, 1_000_000]), rng.choice([3, 40])),
    }
    rows = []
    for s in range(12):
        start = rng.choice([-30_000_000, 0, 1_700_000_000_000_000])
        span, grain = rng.choice([10**6, 10**7, 10**8]), rng.choice([1, 1000, 500_000])
        for _ in range(rng.choice([1, 40, 400, 1500])):
            at = start + rng.randrange(span) // grain * grain
            rows.append((f"s{s}", at, int(rng.random() < 0.6)))
    assert alerts_of(spark, rows, limits) == expected(rows, limits)


@pytest.mark.parametrize("fan", [2, 3])
def test_block_tables_compose_over_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(A, "FAN", fan)
    rng = random.Random(fan)
    limits = {"anomaly": (2_000_000, 5), "traffic": (1_000_000, 3)}
    rows = []
    for s, start in (("a", 0), ("b", -90_000_000), ("c", 1_700_000_003_000_000)):
        spans = rng.sample(range(30), 18)  # blocks without events between
        for _ in range(900):
            at = start + rng.choice(spans) * 10_000_000 + rng.randrange(10_000_000) // 1000 * 1000
            rows.append((s, at, int(rng.random() < 0.7)))
    assert alerts_of(spark, rows, limits) == expected(rows, limits)


def test_a_dense_block_is_cut_into_parts_of_equal_count(spark, monkeypatch):
    groups = []
    monkeypatch.setattr(A, "PART", 250)
    table = A._part_table

    def counting(ks):
        groups.append(table(ks))

        def run(key, candidates):
            assert len(candidates) <= 250
            return table(ks)(key, candidates)

        return run

    monkeypatch.setattr(A, "_part_table", counting)
    rng = random.Random(9)
    limits = {"anomaly": (4_000, 5), "traffic": (1_000_000, 40)}
    # A burst of some thousand instants within one block of 10 s, and a quiet sensor beside it.
    rows = [("burst", 1_700_000_000_000_000 + 977 * i, int(rng.random() < 0.8)) for i in range(6_000)]
    rows += [("burst", 1_700_000_060_000_000 + 1_000_000 * i, 1) for i in range(20)]
    rows += [("quiet", 1_700_000_000_000_000 + 400_000 * i, 1) for i in range(60)]
    got = alerts_of(spark, rows, limits)
    assert got == expected(rows, limits) and len(got["traffic"]) > 100 and groups


def test_dense_session_over_many_blocks(spark):
    # Every event is a candidate, so the phase set at the start holds to the end.
    rows = [("s", 7_000 * i, 1) for i in range(30_000)]
    limits = {"anomaly": (1_000_000, 10)}
    assert alerts_of(spark, rows, limits) == expected(rows, limits)


def test_hot_instant_is_one_row(spark):
    packets = spark.range(3_000_000).select(
        F.lit("s").alias("sensor"), F.lit(5).cast("bigint").alias("event_us"), F.lit(1).alias("is_anomaly")
    )
    points = A.instants(packets, F.col("sensor"))
    assert points.count() == 1
    found = A.find_alerts(points, {"anomaly": (10, 5)})
    stats = found.agg(F.count("*"), F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(stats) == (500_000, 6, 3_000_000, 500_000)


def test_parts_in_time_order_give_the_alerts_of_the_whole(spark):
    rng = random.Random(5)
    limits = {"anomaly": (50_000, 7), "traffic": (20_000, 4)}
    rows = [(rng.choice("ab"), rng.randrange(60_000_000) // 1000 * 1000, int(rng.random() < 0.6)) for _ in range(5000)]
    # Dense stretches, so that windows and resets reach over the borders of the parts.
    rows += [("a", 20_000_000 + 3_000 * i, 1) for i in range(4000)]
    rows += [("late", 55_000_000 + 1_000 * i, 1) for i in range(50)]
    packets = spark.createDataFrame(rows, "sensor string, event_us bigint, is_anomaly int")
    points = materialize(A.instants(packets, F.col("sensor")), "points")
    carried = spark.createDataFrame([], A.CARRIED_SCHEMA)
    got = []
    for low, high in ((0, 20_500_000), (20_500_000, 20_510_000), (20_510_000, 31_000_000), (31_000_000, 60_000_000)):
        part = points.filter(f"event_us >= {low} and event_us < {high}")
        found, carried = A.advance_alerts(part, carried, limits)
        got += [(r.sensor, r.kind, r.event_us, r.rn) for r in found.collect()]
        carried = materialize(carried, "carried")
        for r in carried.collect():
            assert len(r.tail or []) <= limits[r.kind][1] + 1
    want = [(r.sensor, r.kind, r.event_us, r.rn) for r in A.find_alerts(points, limits).collect()]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_window_counts_per_packet(spark):
    rng = random.Random(3)
    rows = [("ab"[rng.random() < 0.7], rng.randrange(40) * 500_000, int(rng.random() < 0.5)) for _ in range(500)]
    packets = spark.createDataFrame(rows, "sensor string, event_us bigint, is_anomaly int")
    for measure in ("packets", "anomalies"):
        got = A.with_window_counts(packets, 2_000_000, measure, F.col("sensor")).collect()
        assert len(got) == 500
        for r in got:
            inside = [
                x for x in rows if x[0] == r.sensor and r.event_us - 2_000_000 <= x[1] <= r.event_us
            ]
            want = len(inside) if measure == "packets" else sum(x[2] for x in inside)
            assert r.window_count == want


def test_packets_without_a_sensor_are_kept(spark):
    packets = spark.createDataFrame(
        [(None, 1, 1), (None, 1, 1), ("a", 1, 1)], "sensor string, event_us bigint, is_anomaly int"
    )
    counted = A.with_window_counts(packets, 10, "packets", F.col("sensor"))
    assert sorted(r.window_count for r in counted.collect()) == [1, 2, 2]
    found = A.find_alerts(A.instants(packets, F.col("sensor")), {"anomaly": (10, 1)})
    assert [(r.sensor, r.rn) for r in found.collect()] == [("", 2)]


def test_limits():
    assert A.alert_limits() == {"anomaly": (10_000_000, 5), "traffic": (1_000_000, 200)}
    assert A.alert_limits(traffic_window=5)["traffic"] == (5_000_000, 1000)
    assert A.alert_limits(traffic_window=0.5)["traffic"] == (500_000, 200)
    with pytest.raises(ValueError):
        A.alert_limits(anomaly_threshold=-1)


def test_partial_sums_before_the_first_shuffle(spark):
    packets = spark.range(10).selectExpr("id as event_us", "1 as is_anomaly")
    plan = A.instants(packets)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan
