"""Every query that has SQL agrees with it; the others have the properties they should have."""

import inspect

import pytest

import __spark_entry__ as spark_entry
from checks.compare import connect, difference
from packetlens.operators import classify

SF = "/root/testdata/sf0.001"
SQL = spark_entry.oracle_sql()
QUERIES = spark_entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, [tuple(r) for r in df.collect()], con, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_progress_counts(spark):
    rows = sorted(r.mark for r in QUERIES["progress_counts"](spark, SF).collect())
    assert rows == list(range(50, 991, 50))


def test_trained_models(spark):
    (forest,) = QUERIES["iforest_train_score"](spark, SF).collect()
    assert tuple(forest) == (990, 990, 990, True)
    same = QUERIES["model_roundtrip"](spark, SF).collect()
    assert len(same) == 990 and all(r.same for r in same)
    rows = QUERIES["rf_train_predict"](spark, SF).collect()
    assert len(rows) == 990 and all(r.label == r.attack_type for r in rows)
    assert tuple(QUERIES["train_job"](spark, SF).first()) == (990, 990, True)


@pytest.mark.parametrize("name", ["train_flow_job", "batch_job", "batch_job_rejects"])
def test_jobs_ask_for_full_forests(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    signature = inspect.signature(classify.fit_classifier)

    def asked(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        raise Asked(call.arguments["trees"], call.arguments["max_depth"])

    monkeypatch.setattr(classify, "fit_classifier", asked)
    with pytest.raises(Asked) as found:
        QUERIES[name](spark, SF)
    assert found.value.args == (150, 30)


def test_result_runs_read_packets_that_are_already_analyzed(spark, monkeypatch):
    from checks import queries

    plans = []

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(queries.reporting, "generate_report", seen)
    queries._result_table(spark, SF)
    # Neither the capture lines nor the models come again.
    assert len(plans) == 3 and not any("RLIKE" in plan or "EvalPython" in plan for plan in plans)
