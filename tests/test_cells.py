import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetlens.operators import cells as K
from packetlens.operators import classify as C


@pytest.fixture(scope="module")
def table(spark):
    """Rows of few values, of which x and y decide the label but for some noise; z does not matter."""
    label = F.when(F.col("x") < 1, "DoS").when(F.col("y") < 2, "PortScan").otherwise("BruteForce")
    made = (
        spark.range(3000)
        .select(
            "id",
            (F.col("id") % 4).cast("double").alias("x"),
            (F.col("id") % 5).cast("double").alias("y"),
            (F.rand(3) * 100).alias("z"),
        )
        .withColumn("attack_type", F.when(F.col("id") % 41 == 0, "DoS").otherwise(label))
        .persist()
    )
    made.count()
    return made


@pytest.fixture
def on_cells(monkeypatch):
    monkeypatch.setattr(C, "CELL_ROWS", 0)


def numbered(table):
    at = F.array_position(F.array(*[F.lit(x) for x in ("BruteForce", "DoS", "PortScan")]), F.col("attack_type"))
    return table.withColumn("label", (at - 1).cast("double"))


def test_cells_count_all_rows(table):
    cells = K.count_cells(numbered(table), ["x", "y", "z"], "label", 8)
    assert list(cells.cuts[0]) == [0.5, 1.5, 2.5] and list(cells.cuts[1]) == [0.5, 1.5, 2.5, 3.5]
    assert len(cells.cuts[2]) == 7
    rows = numbered(table).collect()
    wanted = collections.Counter(
        (*(int(np.searchsorted(c, v)) for c, v in zip(cells.cuts, (r.x, r.y, r.z))), int(r.label)) for r in rows
    )
    got = {(*map(int, b), int(k)): int(n) for b, k, n in zip(cells.bins, cells.label, cells.n)}
    assert got == wanted and sum(got.values()) == 3000


def test_bytes_of_keys_that_are_part_of_an_array():
    keys = pa.array([b"ab", b"cd", b"ef", b"gh"])
    assert bytes(K._bytes(keys, 2)) == b"abcdefgh" and bytes(K._bytes(keys[1:3], 2)) == b"cdef"


def test_cuts_at_odd_values(spark):
    rows = [(float("-inf"), 1.0), (-0.0, 1.0), (0.0, 1.0), (1.0, 1.0), (float("inf"), 1.0)]
    few = K.cut_points(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 64)
    assert list(few[0]) == [float("-inf"), 0.5, 1.0] and list(few[1]) == []
    many = K.cut_points(spark.range(1000).select(F.col("id").cast("double").alias("a")), ["a"], 10)
    assert [abs(c - 100 * (i + 1)) <= 2 for i, c in enumerate(many[0])] == [True] * 9


def test_a_null_or_nan_feature_is_an_error(spark, on_cells, tmp_path):
    for odd in (None, float("nan")):
        rows = spark.createDataFrame([(1.0, 2.0, "a"), (odd, 2.0, "b")], "x double, y double, attack_type string")
        with pytest.raises(ValueError, match="_f0"):
            C.fit_classifier(rows, ["x", "y"], path=str(tmp_path / "m"), trees=2)


def test_cells_and_rows_grow_the_same_tree():
    rng = np.random.default_rng(1)
    bins, label = rng.integers(0, 5, (4000, 3)).astype(np.uint8), rng.integers(0, 3, 4000)
    weight = rng.poisson(1, 4000).astype(float)
    both, back = np.unique(np.column_stack([bins, label]), axis=0, return_inverse=True)
    sums = np.bincount(back.reshape(-1), weights=weight)
    grow = lambda b, k, w: K.grow_tree(b, k, w, [5, 5, 5], 3, 30, np.random.default_rng(7))
    one, other = grow(bins, label, weight), grow(both[:, :3].astype(np.uint8), both[:, 3], sums)
    assert len(one["id"]) > 20
    assert all(np.array_equal(one[c], other[c]) for c in one)


def test_a_tree_splits_at_the_most_gain_and_covers_all_weight(monkeypatch):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 9, (3000, 1)).astype(np.uint8)
    label = ((bins[:, 0] > 5) ^ (rng.random(3000) < 0.1)).astype(int)
    weight = rng.poisson(1, 3000).astype(float)
    tree = K.grow_tree(bins, label, weight, [9], 2, 30, np.random.default_rng(0))

    def gini(rows):
        share = np.bincount(label[rows], weights=weight[rows], minlength=2) / weight[rows].sum()
        return weight[rows].sum() * (1 - (share**2).sum())

    left = [bins[:, 0] <= c for c in range(8)]
    assert tree["cut"][0] == np.argmin([gini(x) + gini(~x) for x in left])
    leaves = tree["left"] < 0
    assert tree["stats"][leaves].sum() == weight.sum()
    for i in np.flatnonzero(~leaves):
        a, b = tree["left"][i], tree["right"][i]
        assert i < a and i < b and np.array_equal(tree["stats"][a] + tree["stats"][b], tree["stats"][i])
        assert not (leaves[a] and leaves[b] and tree["prediction"][a] == tree["prediction"][b])
    # With one feature nothing is drawn, so nodes split a few at a time make the same tree.
    monkeypatch.setattr(K, "HISTOGRAM", 1)
    again = K.grow_tree(bins, label, weight, [9], 2, 30, np.random.default_rng(0))
    order = lambda t: sorted(map(tuple, np.column_stack([t["stats"], t["cut"]])))
    assert order(again) == order(tree)


def test_depth_and_pure_tables():
    bins, label = np.arange(16, dtype=np.uint8)[:, None], np.arange(16) % 2
    for depth, leaves in ((0, 1), (1, 2), (2, 4)):
        tree = K.grow_tree(bins, label, np.ones(16), [16], 2, depth, np.random.default_rng(0))
        assert (tree["left"] < 0).sum() <= leaves
    tree = K.grow_tree(bins, np.zeros(16, int), np.ones(16), [16], 1, 30, np.random.default_rng(0))
    assert list(tree["left"]) == [-1] and list(tree["stats"][0]) == [16.0]


def test_the_model_is_one_of_spark_ml(spark, table, on_cells, tmp_path):
    fitted = C.fit_classifier(table, ["x", "y", "z"], path=str(tmp_path / "m"), trees=15, max_depth=6)
    assert fitted.labels == ["BruteForce", "DoS", "PortScan"]
    flagged = table.withColumnRenamed("attack_type", "truth").withColumn("is_anomaly", F.lit(1))
    columns = ["id", "truth", "_label", "_confidence"]
    ours, theirs = (
        sorted(map(tuple, f(flagged, fitted.features).select(*columns).collect()))
        for f in (fitted.classify, fitted.transform)
    )
    assert [r[:3] for r in ours] == [r[:3] for r in theirs]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(ours, theirs))
    assert sum(r[1] == r[2] for r in ours) / 3000 > 0.96
    again = C.load_classifier(spark, fitted.save(spark, str(tmp_path / "copy")).path)
    assert again.node_count == fitted.node_count > 15
    one = C.fit_classifier(table.withColumn("attack_type", F.lit("one")), ["x"], path=str(tmp_path / "one"), trees=2)
    assert one.node_count == 2 and one.labels == ["one"]


def test_too_many_cells_are_fitted_as_rows(table, on_cells, tmp_path, monkeypatch):
    seen = []

    class Counting(C.RandomForestClassifier):
        def fit(self, dataset):
            seen.append(dataset.count())
            return super().fit(dataset)

    monkeypatch.setattr(C, "RandomForestClassifier", Counting)
    C.fit_classifier(table, ["x", "y"], path=str(tmp_path / "few"), trees=2, max_depth=3)
    monkeypatch.setattr(K, "CELL_BYTES", 1)
    C.fit_classifier(table, ["x", "y"], path=str(tmp_path / "many"), trees=2, max_depth=3)
    assert seen == [3, 3000]


def test_rare_values_can_be_split_off(spark, tmp_path):
    """Splits come from all rows: three of 150,000 are more than a sample of 10,000 is sure to see."""
    rare = F.col("id") % 50_000 == 7
    table = spark.range(150_000).select(
        rare.cast("double").alias("x"), F.when(rare, "ddos").otherwise("normal").alias("attack_type")
    )
    fitted = C.fit_classifier(table, ["x"], path=str(tmp_path / "m"), trees=25)
    rows = spark.createDataFrame([(0.0, 1), (1.0, 1)], "x double, is_anomaly int")
    assert [r.attack_type for r in C.predict_attack_types(rows, fitted).collect()] == ["normal", "ddos"]
