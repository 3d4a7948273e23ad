"""Anomaly scores: planted outliers, missing values, flag shares."""
import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import anomaly


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2000, 2)) @ np.array([[2.0, 1.5], [0.0, 0.6]])
    x[:200] = rng.normal((12, -12), 0.5, (200, 2))
    pdf = pd.DataFrame({"id": np.arange(2000), "a": x[:, 0], "b": x[:, 1]})
    pdf.loc[[500, 501], "a"] = None
    return spark.createDataFrame(pdf)


def test_elliptic_is_not_moved_by_outliers(points):
    got = anomaly.robust_elliptic(points, ["a", "b"], "id", 0.1).toPandas().set_index("id")
    assert len(got) == 2000 and got.anomaly_score.notna().all()
    assert got.is_anomaly.sum() == 200
    assert got.is_anomaly[:200].all()
    # correct scale: the clean rows' squared distances have about the chi-squared mean
    assert 1.0 < (got.anomaly_score[200:] ** 2).mean() < 5.0


def test_forest_scores_every_row(points):
    got = anomaly.isolation_forest(points, ["a", "b"], "id", n_trees=60, contamination=0.1).toPandas().set_index("id")
    again = anomaly.isolation_forest(points.repartition(7), ["a", "b"], "id", n_trees=60, contamination=0.1).toPandas().set_index("id")
    assert len(got) == 2000 and got.anomaly_score.between(0, 1).all()
    assert abs(got.is_anomaly.sum() - 200) <= 2
    assert (again.sort_index().anomaly_score - got.sort_index().anomaly_score).abs().max() < 1e-12
    assert got.anomaly_score[:200].mean() > got.anomaly_score[200:].mean() + 0.05


def test_path_length_term():
    assert anomaly._c(1) == 0 and anomaly._c(2) == pytest.approx(2 * anomaly.EULER - 1)


def test_records_and_empty(points, spark):
    s = anomaly.robust_elliptic(points, ["a", "b"], "id", 0.1, keep=["a"])
    rec = anomaly.anomaly_records(s, "id").collect()
    assert len(rec) == 200 and rec[0].a is not None and rec[0].anomaly_score >= rec[-1].anomaly_score
    assert anomaly.isolation_forest(points.limit(0), ["a", "b"], "id").count() == 0
