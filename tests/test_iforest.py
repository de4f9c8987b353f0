import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.models import frozen_forest
from packetlens.operators import iforest as I
from packetlens.operators.forest import Forest
from packetlens.sources.schemas import PACKET_FEATURES

SCHEMA = ", ".join(f"{c} double" for c in PACKET_FEATURES)


def packet(frame_len, hour, is_tcp):
    values = dict.fromkeys(PACKET_FEATURES, 0.0)
    values.update(frame_len=float(frame_len), hour_of_day=float(hour), is_tcp=float(is_tcp))
    return tuple(values[c] for c in PACKET_FEATURES)


@pytest.fixture(scope="module")
def cloud(spark):
    """A cluster and a few far points."""
    near = spark.range(4000).select(
        "id", (F.randn(1) * 2 + 50).alias("a"), (F.randn(2) * 2 - 10).alias("b"), F.lit(3.0).alias("c")
    )
    far = spark.range(4000, 4020).select(
        "id", (F.randn(3) * 2 + 500).alias("a"), (F.randn(4) * 2 + 300).alias("b"), F.lit(3.0).alias("c")
    )
    table = near.unionAll(far).persist()
    table.count()
    return table


@pytest.fixture(scope="module")
def fitted(cloud):
    return I.fit_isolation_forest(cloud, ["a", "b", "c"], ["id"])


def test_average_path():
    constants = {1: 0.0, 2: 1.0, 256: 10.244770920, 200: 9.751040979, 56: 7.204811986, 6: 2.706640488}
    got = I.average_path(np.array(list(constants)))
    assert np.allclose(got, list(constants.values()), atol=1e-8)


def test_frozen_forest(spark):
    rows = {
        packet(128, 22, 1): (0.066836764, 0),
        packet(64, 22, 0): (0.023373408, 0),
        packet(1500, 3, 1): (-0.042785428, 1),
        packet(1500, 3, 0): (-0.096109941, 1),
        packet(1400, 12, 0): (-0.009179244, 1),
    }
    scored = I.score_packets(spark.createDataFrame(list(rows), SCHEMA), frozen_forest()).collect()
    assert len(scored) == len(rows)
    for r in scored:
        decision, flag = rows[tuple(r[c] for c in PACKET_FEATURES)]
        assert math.isclose(r.anomaly_score, decision, abs_tol=1e-8) and r.is_anomaly == flag


def test_trees_are_well_formed(fitted):
    nodes = fitted.nodes
    roots = nodes[nodes["node"] == 0]
    assert len(roots) == 100 and (roots["n"] == 256).all()
    assert nodes["depth"].max() <= 8 and len(nodes) <= 100 * 511
    assert set(nodes["feature"].dropna()) == {"a", "b"}  # a constant is never split
    size = {(t, n): c for t, n, c in zip(nodes["tree"], nodes["node"], nodes["n"])}
    for r in nodes.dropna(subset=["left"]).itertuples():
        assert size[(r.tree, int(r.left))] + size[(r.tree, int(r.right))] == r.n
        assert min(size[(r.tree, int(r.left))], size[(r.tree, int(r.right))]) > 0


def test_far_points_score_lowest_and_a_fifth_is_flagged(cloud, fitted):
    scored = I.score_packets(cloud, fitted).persist()
    assert abs(scored.agg(F.avg("is_anomaly")).first()[0] - 0.2) < 0.01
    lowest = scored.orderBy("anomaly_score").limit(20).filter("id >= 4000").count()
    assert lowest >= 18
    low, high = fitted_range(cloud, fitted)
    assert -1 < low < high < 0


def fitted_range(cloud, fitted):
    score = fitted.score(cloud.sparkSession, fitted.features)
    return tuple(cloud.select(score.alias("s")).agg(F.min("s"), F.max("s")).first())


def test_partitioning_does_not_change_the_model(cloud, fitted):
    again = I.fit_isolation_forest(cloud.repartition(13), ["a", "b", "c"], ["id"])
    assert again.nodes.equals(fitted.nodes) and again.offset == fitted.offset


def test_other_seed_changes_it(cloud, fitted):
    other = I.fit_isolation_forest(cloud, ["a", "b", "c"], ["id"], trees=100, seed=7)
    assert not other.nodes.equals(fitted.nodes)


def test_more_rows_than_the_cap(cloud):
    model = I.fit_isolation_forest(cloud, ["a", "b"], ["id"], trees=10, max_rows=1000)
    assert (model.nodes[model.nodes["node"] == 0]["n"] == 256).all()


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, a double")
    model = I.fit_isolation_forest(table, ["a"], ["id"], trees=5)
    assert model.sample_size == 10 and model.nodes["depth"].max() <= 4
    with pytest.raises(ValueError, match="empty"):
        I.fit_isolation_forest(table.filter("a < 0"), ["a"], ["id"])


def test_save_and_load(spark, cloud, fitted, tmp_path):
    path = fitted.save(spark, str(tmp_path / "m"))
    loaded = I.load_isolation_forest(spark, path)
    both = cloud.select(
        fitted.score(spark, fitted.features).alias("x"), loaded.score(spark, fitted.features).alias("y")
    )
    assert both.filter("x <> y").count() == 0
    assert loaded.offset == fitted.offset and loaded.features == fitted.features


def test_a_reader_has_whole_versions(spark, fitted, tmp_path, monkeypatch):
    path = fitted.save(spark, str(tmp_path / "m"))
    newer = I.IsolationForestModel(fitted.nodes, fitted.features, fitted.sample_size, fitted.offset - 0.1)
    seen = []

    def reading(*args, publish=I.write_meta):  # between the data of a version and its publication
        seen.append(I.load_isolation_forest(spark, path).offset)
        publish(*args)

    monkeypatch.setattr(I, "write_meta", reading)
    newer.save(spark, path)
    assert seen == [fitted.offset]
    assert I.load_isolation_forest(spark, path).offset == newer.offset
    fitted.save(spark, path)
    assert I.load_isolation_forest(spark, path).offset == fitted.offset


def test_load_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        I.load_isolation_forest(spark, "")
    with pytest.raises(FileNotFoundError):
        I.load_isolation_forest(spark, str(tmp_path / "nothing"))
    I.write_meta(spark, {"kind": "attack_classifier"}, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="expected"):
        I.load_isolation_forest(spark, str(tmp_path / "other"))


def test_missing_features_flag_nothing(spark):
    table = spark.createDataFrame([(1.0,)], "frame_len double")
    row = I.score_packets(table, frozen_forest()).first()
    assert (row.is_anomaly, row.anomaly_score) == (0, 0.0)
    with pytest.raises(ValueError, match="Missing"):
        I.score_packets(table, frozen_forest(), strict_schema=True)


def test_filter_needs_the_flag(spark):
    with pytest.raises(ValueError, match="is_anomaly"):
        I.filter_anomalies(spark.range(1))


def test_rows_of_trees_are_drawn_by_compiled_code(cloud, monkeypatch):
    plans, group = [], type(cloud).groupBy

    def seen(df, *columns):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return group(df, *columns)

    monkeypatch.setattr(type(cloud), "groupBy", seen)
    I.fit_isolation_forest(cloud, ["a", "b", "c"], ["id"], trees=3)
    drawn = [plan for plan in plans if "explode" in plan]
    assert drawn and not any("lambda" in plan for plan in drawn)


def test_batches_reach_the_leaves_of_single_rows():
    # Two trees of unequal depth, and a single leaf; children stand in either order.
    parts = dict(
        roots=[0, 5, 8], feature=[1, 0, 0, 0, 0, 0, 0, 0, 0],
        threshold=[2.0, np.nan, -1.0, np.nan, np.nan, 0.5, np.nan, np.nan, np.nan],
        left=[1, -1, 4, -1, -1, 7, -1, -1, -1], right=[2, -1, 3, -1, -1, 6, -1, -1, -1],
        value=[[0.1 * i, 1.0 / (i + 1)] for i in range(9)], depth=[0, 1, 1, 2, 2, 0, 1, 1, 0],
    )
    numbers = [-np.inf, -1.0, -0.0, 0.0, 0.5, 2.0, 3.0, np.inf, np.nan]
    rows = np.array([(a, b) for a in numbers for b in numbers] * 2)

    def leaf(node, row):
        while parts["left"][node] >= 0:
            below = row[parts["feature"][node]] <= parts["threshold"][node]
            node = parts["left" if below else "right"][node]
        return np.array(parts["value"][node])

    want = []
    for row in rows:
        total = np.zeros(2)
        for root in parts["roots"]:
            total += leaf(root, row)
        want.append(total)
    forest = Forest(**parts)
    assert np.array_equal(forest.total(rows), want)
    assert all(np.array_equal(forest.total(rows[i : i + 1])[0], want[i]) for i in range(0, len(rows), 7))
    # Children are neighbours, so that a step is one look-up and a comparison.
    assert sorted(forest.child[forest.child != np.arange(9)].tolist()) == [3, 5, 7]


def test_infinite_input_goes_to_one_side(spark):
    rows = [packet(math.inf, 12, 1), packet(-math.inf, 12, 1), packet(math.nan, 12, 1)]
    scored = I.score_packets(spark.createDataFrame(rows, SCHEMA), frozen_forest())
    assert scored.filter("isnan(anomaly_score) or anomaly_score is null").count() == 0


def test_other_inputs_than_trained_on(spark):
    table = spark.createDataFrame([packet(1, 2, 1)], SCHEMA)
    with pytest.raises(ValueError, match="trained"):
        I.score_packets(table, frozen_forest(), ["frame_len", "hour_of_day"])
    reordered = I.score_packets(table, frozen_forest(), list(reversed(PACKET_FEATURES))).first()
    assert reordered.anomaly_score == I.score_packets(table, frozen_forest()).first().anomaly_score
