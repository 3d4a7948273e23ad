"""Per-key ridge regressions against fits on the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ridge


def plain(x, y, alpha=1.0):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - w @ mean, w


def test_models_equal_fits_on_the_rows(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, n in (("hot", 400), ("b", 30), ("c", 10), ("few", 9), ("flat", 12)):
        x = rng.normal(size=(n, 3)) * [1, 50, 0.1] + [0, 1000, 5]
        x[:, 2] = 5.0 if key == "b" else x[:, 2]  # a constant feature
        y = x @ [2.0, 0.1, 3.0] + rng.normal(size=n) if key != "flat" else np.full(n, 7.0)
        fold = np.arange(n) % 5
        rows += [(key, int(f), *map(float, v), float(t), "x") for f, v, t in zip(fold, x, y)]
        want[key] = x, y, fold
    rows += [("c", 0, None, 1.0, 1.0, 1.0, "x"), ("c", 0, float("nan"), 1.0, 1.0, 1.0, "x"), (None, 0, 1.0, 1.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "k string, f int, a double, b double, c double, y double, n string").repartition(5)
    got = {r.k: r for r in ridge.fit_per_key(df, "k", ["a", "b", "c"], "y", F.col("f")).collect()}
    assert set(got) == {"hot", "b", "c", "flat"}
    for key, r in got.items():
        x, y, fold = want[key]
        b, w = plain(x, y)
        assert np.allclose([r.intercept, *r.coefs], [b, *w], rtol=1e-6, atol=1e-6)
        assert r.n == len(y) and abs(r.rmse - np.sqrt(((y - b - x @ w) ** 2).mean())) < 1e-5
        cv = []
        for f in range(5):
            b, w = plain(x[fold != f], y[fold != f])
            cv.append(np.sqrt(((y - b - x @ w)[fold == f] ** 2).mean()))
        assert abs(r.cv_rmse - np.mean(cv)) < 1e-5
        assert r.r2 is None if key == "flat" else r.r2 > 0.5


def test_rows_are_split_by_model(spark):
    models = spark.createDataFrame([("a", 1.0, [2.0])], "k string, intercept double, coefs array<double>")
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), (None, 1.0), ("a", None)], "k string, x double")
    scored, failed = ridge.score_per_key(df, models, "k", ["x"])
    assert sorted((r.k, r.prediction) for r in scored.collect() if r.x) == [("a", 7.0)] and scored.count() == 2
    assert sorted(str(r.k) for r in failed.collect()) == ["None", "b"] and failed.first().error == "no model"


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, f int, a double, y double")
    assert ridge.fit_per_key(df, "k", ["a"], "y", F.col("f")).count() == 0
    with pytest.raises(Exception):
        ridge.fit_per_key(df, "k", ["missing"], "y", F.col("f"))
