from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from packetlens.llm import quality
from packetlens.llm.frames import crc_of_id
from packetlens.llm.oracle import ORACLE
from packetlens.sources.workspace import materialize

SF = "/root/testdata/sf0.001"


def view(con, name, rows):
    con.register(name, rows.toPandas())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, run in corpus_pipeline.STAGES:
        out.append(materialize(run(spark, out[-1], SF), name))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "mixing", "sharding"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_quality_keeps_the_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * (len(labels) - len(good))


def test_near_duplicates_as_in_sql(stages):
    con = duckdb.connect()
    con.register("documents", stages[1].select("doc_id", "text").toPandas())
    rows = con.execute(f"select doc_id from ({ORACLE['op10_near_dedup']}) where kept").fetchall()
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(r[0] for r in rows)


def test_decontamination_as_in_sql(spark, stages):
    con = duckdb.connect()
    con.register("documents", stages[2].select("doc_id", "text").toPandas())
    con.register("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet").toPandas())
    rows = con.execute(f"select doc_id from ({ORACLE['op7_decontamination']}) where not contaminated").fetchall()
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r[0] for r in rows)


def test_mixing_takes_a_part(stages):
    before, after = stages[3].count(), stages[4].count()
    assert 0 < after < before
    assert stages[4].select("doc_id").subtract(stages[3].select("doc_id")).isEmpty()


def test_shards_hold_all(stages):
    rows = stages[5].select("doc_id", "shard", "slot").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_run_and_odd_rows(spark, docs, stages):
    table = docs(
        (None, None), (1, ""), (2, "x"), (2, "x"), (3, "word " * 30_000), (4, None),
        extra=", shard int, score double, topic string, key int, drawn int", values=(1, 2.0, "t", 3, 4),
    )
    for source in (table, table.limit(0), spark.createDataFrame([(None,) * 10], table.schema)):
        rows = source
        for name, run in corpus_pipeline.STAGES[:-1]:
            rows = materialize(run(spark, rows, SF), name)
            assert rows.columns == table.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert last.count() == rows.count()
        assert last.columns == [*table.columns, "_shard", "slot"]


def test_held_out_labels_are_not_learned(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.filter(crc_of_id() % 5 == 0).count()
    assert 0 < held < labels.count() and quality.SAMPLE > 0
