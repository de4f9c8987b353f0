import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetlens.llm import sharding


def chance(total, marked, drawn, x):
    return math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)


@pytest.mark.parametrize("case", [(10, 4, 5), (50, 20, 7), (6, 6, 3), (9, 0, 4), (5, 3, 0), (400, 3, 200)])
def test_hypergeometric_inverts_its_distribution(spark, case):
    total, marked, drawn = case
    n = 2000
    values = [F.lit(x).cast("bigint") for x in case]
    u = (F.col("id") + 0.5) / n
    rows = spark.range(n).select(sharding.hypergeometric(*values, u).alias("x")).collect()
    seen = Counter(r.x for r in rows)
    for x in range(max(0, drawn - total + marked), min(drawn, marked) + 1):
        assert seen.pop(x, 0) == pytest.approx(n * chance(total, marked, drawn, x), abs=3)
    assert not seen


def test_large_numbers(spark):
    case = [F.lit(x).cast("bigint") for x in (10**11, 10**10, 10**9)]
    u = (F.col("id") + 0.5) / 400
    rows = [r.x for r in spark.range(400).select(sharding.hypergeometric(*case, u).alias("x")).collect()]
    spread = math.sqrt(1e9 * 0.1 * 0.9 * 0.99)
    mean = sum(rows) / 400
    assert abs(mean - 1e8) < 4 * spread / 20  # values are summed from the middle outwards, so equal steps of u are a sample
    assert math.sqrt(sum((x - mean) ** 2 for x in rows) / 400) == pytest.approx(spread, rel=0.15)


def test_matrix_has_given_margins(spark):
    rng = random.Random(1)
    counts = {p: rng.randrange(0, 90) for p in range(16) if p % 5}
    table = spark.createDataFrame(list(counts.items()), "part int, n bigint")
    rows = {r.part: list(r.needs) for r in sharding.communication_matrix(table, 7, 16, 3).collect()}
    assert {p: sum(v) for p, v in rows.items()} == {p: counts.get(p, 0) for p in range(16)}
    sizes = [sum(v[s] for v in rows.values()) for s in range(7)]
    assert sum(sizes) == sum(counts.values()) and max(sizes) - min(sizes) <= 1


def placed(df, seed):
    return {(r.shard, r.slot): r.k for r in sharding.shard(df, 4, 8, seed).collect()}


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    assert [sharding.source_partitions(n) for n in (0, 1, 128_000_000, 128_000_001, 10**11)] == [128, 128, 128, 256, 131072]
    drawn, matrix = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "PARTITIONS", 2)
    monkeypatch.setattr(sharding, "ROWS_PER_PARTITION", 10)
    monkeypatch.setattr(sharding, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(
        sharding, "communication_matrix", lambda *args: drawn.append(args[2]) or matrix(*args)
    )
    for n, partitions in ((15, 2), (77, 8)):
        df = spark.range(n).withColumnRenamed("id", "k")
        rows = [(r.shard, r.slot, r.k) for r in sharding.shard(df, 4).collect()]
        assert drawn.pop() == partitions and sorted(r[2] for r in rows) == list(range(n))
        sizes = Counter(r[0] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        assert sorted(r[:2] for r in rows) == sorted((s, i) for s in sizes for i in range(sizes[s]))


def test_every_place_is_equally_likely(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    seen = defaultdict(Counter)
    runs = 24
    for seed in range(runs):
        where = placed(df, seed)
        assert sorted(where.values()) == list(range(10))
        for (s, _), k in where.items():
            seen[s][k] += 1
    sizes = [3, 3, 2, 2]
    total = sum((seen[s][k] - runs * z / 10) ** 2 / (runs * z / 10) for s, z in enumerate(sizes) for k in range(10))
    assert total < 60  # chi-square with 27 degrees of freedom: one case in 4,000
    assert placed(df, 3) == placed(df, 3)


def test_edge_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 5)
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 100_000), *[(7, "same")] * 300]
    table = docs(*rows, extra=", shard int, slot string, _row int, _part int", values=(1, "a", 2, 3))
    out = sharding.shard(table, 3, 4)
    assert out.columns == [*table.columns, "_shard", "_slot"]
    got = out.collect()
    by = defaultdict(list)
    for r in got:
        by[r["_shard"]].append(r["_slot"])
    assert {s: sorted(v) for s, v in by.items()} == {
        s: list(range(n)) for s, n in enumerate([102, 101, 101])
    }
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sharding.shard(docs(), 3, 4).collect() == []
