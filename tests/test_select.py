"""Exact quantiles by refined histograms."""
import math

import numpy as np
import pytest

from ledgerline.operators import stats

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "one", "huge", "tiny gaps"])
def test_equals_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(stats, "SELECT_BUCKETS", 8)
    rng = np.random.default_rng(4)
    v = {"normal": rng.normal(size=999), "skewed": np.exp(rng.normal(size=500) * 12), "ties": rng.integers(0, 3, 700).astype(float),
         "one": np.array([5.0]), "huge": np.concatenate([[-1.7e308, 1.7e308], rng.normal(size=200)]),
         "tiny gaps": 1.0 + np.arange(300) * 2.3e-16}[kind]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(9999, None)], "id long, v double").repartition(4)
    row = stats.exact_quantiles(df, "v", "id", PROBS, "q").first()
    assert row["n"] == len(v)
    s = np.sort(v)
    for p, q in zip(PROBS, row["q"]):
        x = p * (len(v) - 1)
        lo, hi = s[math.floor(x)], s[math.ceil(x)]
        assert q == pytest.approx(lo + (hi - lo) * (x - math.floor(x)), rel=1e-12)


def test_infinite_missing_and_empty(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    row = stats.exact_quantiles(df, "v", "v", [0.0, 0.25, 0.5, 0.75, 1.0], "q").first()
    assert row["n"] == 5 and row["q"][:4] == [float("-inf"), 1.0, 2.0, float("inf")] and math.isnan(row["q"][4])
    assert tuple(stats.exact_quantiles(df.limit(0), "v", "v", [0.5], "q").first()) == (None, 0)


def test_no_sort(spark):
    df = spark.range(1000).selectExpr("id", "cast(id AS double) AS v")
    assert "rangepartitioning" not in stats.exact_quantiles(df, "v", "id", [0.5])._jdf.queryExecution().toString()
    assert stats.exact_quantiles(df, "v", "id", [0.5]).first()["edges"] == [499.5]
