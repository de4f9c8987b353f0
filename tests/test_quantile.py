import numpy as np
import pytest

from packetlens.operators import quantile as Q


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("kind", ["normal", "ties", "few", "skewed"])
def test_equals_numpy(spark, monkeypatch, share, kind):
    monkeypatch.setattr(Q, "COUNTED_VALUES", 50)
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "few": np.array([3.0, 1.0, 2.0]),
        "skewed": np.concatenate([np.zeros(2500), rng.exponential(size=500)]),
    }[kind]
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert Q.exact_quantile(table, "v", share) == pytest.approx(np.quantile(values, share))


def test_no_values(spark):
    with pytest.raises(ValueError):
        Q.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5)
