import hashlib

from pyspark.sql import functions as F

from packetlens.operators import sampling as S


def table(spark, n=20_000):
    # One class holds nine tenths of the rows, another has a single row.
    label = F.when(F.col("id") == 7, "rare").when(F.col("id") % 10 == 0, "ddos").otherwise("normal")
    return spark.range(n).withColumn("attack_type", label)


def lowest(ids, n):
    return sorted(sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:n])


def test_uniform_is_exact_and_by_hash(spark):
    got = sorted(r.id for r in S.sample_uniform(table(spark), 3000, ["id"]).collect())
    assert got == lowest(range(20_000), 3000)


def test_uniform_keeps_all_rows_when_few(spark):
    assert S.sample_uniform(table(spark, 50), 3000, ["id"]).count() == 50
    assert S.sample_uniform(table(spark, 50), 50, ["id"]).count() == 50


def test_stratified_sizes(spark):
    rows = S.sample_stratified(table(spark), ["id"], max_rows=1000).collect()
    by_class = {}
    for r in rows:
        by_class.setdefault(r.attack_type, []).append(r.id)
    sizes = {k: len(v) for k, v in by_class.items()}
    assert sizes == {"normal": 899, "ddos": 100, "rare": 1}
    assert sorted(by_class["ddos"]) == lowest(range(0, 20_000, 10), 100)


def test_stratified_below_the_cap_is_everything(spark):
    assert S.sample_stratified(table(spark, 500), ["id"], max_rows=500).count() == 500


def test_many_classes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 1)
    assert S.sample_stratified(table(spark), ["id"], max_rows=1000).count() == 1000


def test_size_is_exact_even_if_keys_repeat(spark):
    same = spark.range(5000).withColumn("k", F.lit("one"))
    assert S.sample_uniform(same, 100, ["k"]).count() == 100


def test_any_partitioning_gives_the_same_rows(spark):
    a = S.sample_uniform(table(spark).repartition(7), 500, ["id"]).collect()
    b = S.sample_uniform(table(spark).coalesce(1), 500, ["id"]).collect()
    assert sorted(r.id for r in a) == sorted(r.id for r in b)


def test_null_is_a_class(spark):
    label = F.when(F.col("id") % 2 == 0, F.col("attack_type"))
    rows = table(spark).withColumn("attack_type", label)
    got = S.sample_stratified(rows, ["id"], max_rows=1000).groupBy("attack_type").count().collect()
    assert {r.attack_type: r["count"] for r in got} == {None: 500, "normal": 400, "ddos": 100}
    assert S.sample_stratified(rows, ["id"], max_rows=20_000).count() == 20_000


def test_no_window_over_a_whole_class(spark):
    plan = S.sample_uniform(table(spark), 3000, ["id"])._jdf.queryExecution().analyzed().toString()
    assert "row_number" in plan and "windowspecdefinition(_stratum#" in plan
    assert all("_prefix" in line for line in plan.splitlines() if "row_number()" in line and "Window" in line)


def test_empty_input(spark):
    assert S.sample_uniform(table(spark).filter("id < 0"), 10, ["id"]).count() == 0


def test_two_scans_and_no_retry(spark, tmp_path, monkeypatch):
    """Keys that all hash alike, quotas of a single row and whole classes: always two scans."""
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") < 3500, F.lit("one")).otherwise(F.col("id").cast("string")))
    rows = rows.withColumn("attack_type", F.when(F.col("id") % 400 == 1, "rare").otherwise("often"))
    rows.write.parquet(str(tmp_path / "t"))
    written = []
    plain = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, purpose: written.append((purpose, df)) or plain(df, purpose))
    table = spark.read.parquet(str(tmp_path / "t"))
    for most in (1, 10, 3000):
        written.clear()
        got = S.sample_stratified(table, ["k"], max_rows=most).groupBy("attack_type").count().collect()
        want = {"rare": max(1, 10 * most // 4000), "often": max(1, 3990 * most // 4000)}
        assert {r.attack_type: r["count"] for r in got} == want
        scans = [p for p, df in written if str(tmp_path) in "".join(df.inputFiles())]
        assert scans == ["hash-counts", "drawn"]
