"""Forests against a plain tree builder, distributed against local growing, searches."""
import math

import numpy as np
import pytest

from ledgerline.operators import forest, ml


def brute_tree(codes, y, w, min_leaf=1, min_split=2, depth=99):
    """Nested tuples: (value,) or (value, feature, code, left, right)."""
    value = (w * y).sum() / w.sum()
    if len(y) < min_split or depth == 0 or np.ptp(y) == 0:
        return (value,)
    best = None
    for f in range(codes.shape[1]):
        for c in np.unique(codes[:, f])[:-1]:
            left = codes[:, f] <= c
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            score = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if best is None or score > best[0] + 1e-9:
                best = score, f, c, left
    if best is None:
        return (value,)
    _, f, c, left = best
    return value, f, int(c), *(brute_tree(codes[s], y[s], w[s], min_leaf, min_split, depth - 1) for s in (left, ~left))


def nested(t, i=0):
    if t["feature"][i] < 0:
        return (t["value"][i],)
    return t["value"][i], t["feature"][i], t["code"][i], nested(t, t["left"][i]), nested(t, t["left"][i] + 1)


def same(a, b):
    return len(a) == len(b) and abs(a[0] - b[0]) < 1e-9 and (len(a) == 1 or (a[1:3] == b[1:3] and same(a[3], b[3]) and same(a[4], b[4])))


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("kw", [{}, {"min_leaf": 3}, {"min_split": 12}, {"depth": 3}])
def test_tree_equals_plain_builder(monkeypatch, kw, few):
    monkeypatch.setattr(forest, "FEW_CODES", few)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 9, (150, 4)).astype(np.uint8)
    y, w = rng.normal(size=150).round(2), rng.integers(1, 4, 150).astype(float)
    tree = forest.grow_tree(codes, y, w, [0], **kw)
    assert same(nested(tree), brute_tree(codes, y, w, **kw))
    leaf = forest.leaf_of(tree, codes)
    assert (tree["feature"][leaf] == -1).all()


def test_cut_tree_is_the_shallow_tree():
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 200, (400, 6)).astype(np.uint8), rng.integers(0, 2, 400).astype(float)
    deep = forest.grow_tree(codes, y, np.ones(400), [3], tried=2)
    flat = forest.grow_tree(codes, y, np.ones(400), [3], depth=4, tried=2)
    assert np.allclose(deep["value"][forest.leaf_of(deep, codes, 4)], flat["value"][forest.leaf_of(flat, codes)])


def _frame(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (x[:, 0] > 0.3) * 2.0 + x[:, 1] + rng.normal(size=n) * 0.1
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(4), x, y


def test_distributed_growing_equals_local_growing(spark, monkeypatch):
    """Upper levels by histograms give the trees that one task would grow."""
    df, x, _ = _frame(spark, 600)
    whole = forest.grow_forest(df, "id", "x", "y", trees=3)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 5)
    parts = forest.grow_forest(df, "id", "x", "y", trees=3)
    assert any(len(t["feature"]) > 1 for t in parts.tops.values())
    codes = forest.to_codes(x, whole.edges)
    for a, b in zip(next(whole.groups()), next(parts.groups())):
        assert len(a["feature"]) == len(b["feature"])
        assert np.allclose(a["value"][forest.leaf_of(a, codes)], b["value"][forest.leaf_of(b, codes)])
        assert np.array_equal(a["level"][forest.leaf_of(a, codes)], b["level"][forest.leaf_of(b, codes)])
    assert np.allclose(whole.importances(), parts.importances())


def test_scoring_in_groups(spark, monkeypatch):
    df, x, y = _frame(spark, 500)
    grown = forest.grow_forest(df, "id", "x", "y", trees=6)
    one = {r.id: r.tree_values for r in grown.tree_values(df, "x").collect()}
    monkeypatch.setattr(forest, "MODEL_BYTES", 1)
    several = {r.id: r.tree_values for r in grown.tree_values(df, "x").collect()}
    assert one == several and len(one[0]) == 6
    mean = np.array([np.mean(one[i]) for i in range(500)])
    assert np.corrcoef(mean, y)[0, 1] > 0.97 and grown.importances()[0] > grown.importances()[2]


def test_bag_is_a_bootstrap():
    times = forest.bag(np.arange(100000), 5, 1)
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - math.exp(-1)) < 0.01
    assert not np.array_equal(times, forest.bag(np.arange(100000), 6, 1))


def test_missing_values_and_one_row(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")], 5.0)], "id long, x array<double>, y double")
    grown = forest.grow_forest(df, "id", "x", "y", trees=3)
    assert [v for v in grown.tree_values(df, "x").first().tree_values if v] in ([5.0], [5.0, 5.0], [5.0, 5.0, 5.0], [])
    with pytest.raises(ValueError):
        forest.grow_forest(df.limit(0), "id", "x", "y")


def test_search_covers_every_point(spark, monkeypatch):
    """The table has every point of the grid; scores equal those of fits of their own."""
    df, x, y = _frame(spark, 240)
    monkeypatch.setattr(forest, "BATCH_TREES", 3)
    df = df.selectExpr("id", "x", "cast(y > 0.8 AS double) AS y")
    sample = forest.draw_sample(df, "id", "x", "y", None, 3)
    assert sorted(np.bincount(sample[4])) == [80, 80, 80] or abs(np.diff(np.bincount(sample[4]))).max() <= 2
    grid = {"trees": [4, 8], "depth": [None, 2], "min_split": [2, 60]}
    point, table = forest.best_point(spark, "random_forest", grid, sample, 3)
    scores = {r.point: r.score for r in table.collect()}
    assert len(scores) == 8 and max(scores.values()) > 0.9 and set(point) == set(grid)
    for i, p in enumerate(forest.product(*grid.values())):
        own = {k: [v] for k, v in zip(grid, p)}
        alone = forest.best_point(spark, "random_forest", own, sample, 3)[1].first().score
        assert abs(alone - scores[i]) < 1e-9
    grid = {"rounds": [5, 20], "step": [0.1], "depth": [2, 3], "share": [0.8, 1.0]}
    point, table = forest.best_point(spark, "gradient_boosting", grid, sample, 3, "f1")
    assert table.count() == 8 and table.agg({"score": "max"}).first()[0] > 0.85


def test_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("id", "array(cast(id AS double)) AS x", "cast(id % 10 = 0 AS double) AS y")
    uid, x, y, w, fold = forest.draw_sample(df, "id", "x", "y", None, 5, rows=300)
    assert len(uid) == 300 and 5 < y.sum() < 70 and np.bincount(fold, minlength=5).min() >= 55


def test_trained_models(spark):
    df, _, _ = _frame(spark, 300)
    df = df.selectExpr("id", "x[0] AS a", "x[1] AS b", "CASE WHEN x[2] > 0 THEN 'u' ELSE 'v' END AS c", "cast(y > 0.8 AS double) AS label")
    grids = {"logistic_regression": {"C": [0.1, 1.0], "elasticNetParam": [1.0, 0.0]}, "random_forest": {"trees": [10], "depth": [None, 2]},
             "gradient_boosting": {"rounds": [3, 6], "step": [0.1], "depth": [2], "share": [1.0]}}
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    table, best = ml.train_classifiers(train, test, ["a", "b"], ["c"], "id", grids)
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == set(grids) and sum(r.selected for r in rows.values()) == 1 and rows["random_forest"].auc > 0.9
    scored = ml.score_binary(best, test, "id").collect()
    assert len(scored) == test.count() and all(0 <= r.probability <= 1 for r in scored)
    assert ml.feature_importance(best, test, 10).count() == 5
    table, refined = ml.train_and_refine(train, test, ["a", "b"], ["c"], "id", k=3, grids=grids)
    assert table.count() == 4 and ml.feature_importance(refined, ml.balanced_weights(train), 10).count() == 3


def test_grids_are_whole():
    """Fixed sizes of the flows' searches."""
    size = lambda g: {k: math.prod(len(v) for v in p.values()) for k, p in g.items()}
    assert size(ml.CHURN_GRIDS) == {"logistic_regression": 8, "random_forest": 24, "gradient_boosting": 16}
    assert size(ml.PURCHASE_GRIDS) == {"random_forest": 4}
    assert size(ml.RETENTION_GRIDS) == {"logistic_regression": 3, "random_forest": 6, "gradient_boosting": 4}


def test_logistic_equals_spark(spark):
    """The search's own fits reach the optimum that the final fit has."""
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(r), float(v), 1.0) for r, v in zip(x, y)], ["features", "label", "weight"])
    for point in ({"C": 0.1, "elasticNetParam": 1.0}, {"C": 10.0, "elasticNetParam": 0.0}):
        model = ml.logistic(300, point).setTol(1e-10).fit(df)
        b, coef = forest.logistic(x, y, np.ones(300), 1 / (point["C"] * 300), point["elasticNetParam"])
        assert np.allclose(coef, model.coefficients.toArray(), atol=2e-3) and abs(b - model.intercept) < 2e-3
