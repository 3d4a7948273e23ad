"""A search over a table too large for one task still fits and scores every row."""
import numpy as np
import pytest

from ledgerline.operators import forest, ml

GRIDS = {"logistic_regression": {"C": [0.001, 1.0]}, "random_forest": {"trees": [4, 8], "depth": [None, 2], "min_split": [2, 60]},
         "gradient_boosting": {"rounds": [2, 5], "step": [0.1], "depth": [2], "share": [1.0]}}


def _encoded(spark, n=240):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), "uv"[i % 2], float((a > 0) ^ (b > 0.5))) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, label double").repartition(3)
    return ml.encode(df, ml.feature_stages(["a", "b"], ["c"]), "id")[1]


@pytest.mark.parametrize("name", list(GRIDS))
@pytest.mark.parametrize("sent", [True, False])
def test_every_row_is_searched(spark, monkeypatch, name, sent):
    if name != "random_forest" and not sent:
        pytest.skip("forests only")
    monkeypatch.setattr(forest, "SEARCH_ROWS", 50)
    if not sent:  # routed through upper parts and subtrees
        monkeypatch.setattr(forest, "MODEL_BYTES", 0)
        monkeypatch.setattr(forest, "LOCAL_ROWS", 40)
    x = _encoded(spark)
    grid, seen = GRIDS[name], {}
    monkeypatch.setattr(forest, "pick_point", lambda kind, g, scored, metric, own=forest.pick_point: seen.setdefault(0, (own(kind, g, scored, metric), scored))[0])
    point = ml.search(name, grid, x, 3, "f1")
    assert set(point) == set(grid)
    scored = seen[0][1].toPandas()
    assert len(seen[0][0][1].collect()) == len(scored.point.unique()) == len(list(forest.product(*grid.values())))
    for _, own in scored.groupby("point"):
        assert sorted(own.row) == sorted(set(own.row)) and len(own) == 240 and own.value.notna().all()
        assert abs(own.groupby(["fold", "y"]).size().unstack().diff().iloc[1:]).max().max() <= 1  # folds within labels
    if name == "random_forest":  # no point sees its held-out rows: some are wrong, most are right
        cut = {i: ((g.value >= 0.5) == (g.y == 1)).mean() for i, g in scored.groupby("point")}
        assert 0.8 < cut[4] < 1
        assert len({tuple(g.sort_values("row").value.round(9)) for _, g in scored.groupby("point")}) > 4


def test_first_rounds(spark):
    x = _encoded(spark, 120)
    point = {"rounds": 6, "step": 0.1, "depth": 2, "share": 1.0}
    whole, short = ml.boosting(point).fit(x), ml.boosting({**point, "rounds": 3}).fit(x)
    raw = lambda m: [r.rawPrediction[1] for r in m.transform(x).orderBy("_key").collect()]
    assert raw(ml.first_rounds(whole, 3)) == pytest.approx(raw(short)) and raw(ml.first_rounds(whole, 6)) == raw(whole)
