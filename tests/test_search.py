"""The registered queries train by the whole search and the whole forest."""
import pytest

from ledgerline.operators import ml
from ledgerline.plans import q_extra, q_forecast, q_ml

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize("query, want", [
    (q_ml.q_churn_train, ml.CHURN_GRIDS), (q_ml.q_purchase_train, ml.PURCHASE_GRIDS), (q_ml.q_purchase_score, ml.PURCHASE_GRIDS),
    (q_ml.q_retention_train, ml.RETENTION_GRIDS),
    (q_extra.q_retention_score, {"logistic_regression": ml.CHURN_GRIDS["logistic_regression"]}),
    (q_extra.q_model_report, {n: ml.CHURN_GRIDS[n] for n in ("random_forest", "logistic_regression")})])
def test_queries_search_the_full_grids(monkeypatch, query, want):
    def asked(train, test, numeric, categorical, key, grids=None, metric=None, only=None):
        raise Asked({n: (grids or ml.RETENTION_GRIDS)[n] for n in only or grids or ml.RETENTION_GRIDS})

    for name in ("churn_frame", "quality_frame"):
        monkeypatch.setattr(q_ml, name, lambda *a, **kw: None)
    monkeypatch.setattr(q_ml, "_split", lambda *a: (None, None))
    monkeypatch.setattr(ml, "train_classifiers", asked)
    monkeypatch.setattr(ml, "train_and_refine", asked)
    with pytest.raises(Asked) as got:
        query(None, SF)
    assert got.value.args[0] == want


def test_demand_forest_is_whole(spark):
    model, df = q_forecast.demand_model(spark, SF)
    assert len(model.forest.tops) == 100
    tree = next(model.forest.groups())[0]
    inner = tree["feature"] >= 0
    assert inner.sum() > 500 and tree["level"].max() > 12  # grown until the leaves are pure
