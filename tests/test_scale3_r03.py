"""A small forest gives its tasks one number a row to hold, unless every tree is asked for."""
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ml


@pytest.mark.parametrize("classes", [True, False])
def test_scoring_holds_one_number_a_row(spark, classes):
    rows = [(i, float(i * 7919 % 101), None if i % 17 == 0 else float(i * 31 % 13), "ab"[i % 2], float(i * 7919 % 101 + i % 5 > 60) if classes else i % 9 / 7)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, label double").repartition(3)
    encoder, x = ml.encode(df, ml.feature_stages(["a", "b"], ["c"], scale=classes), "id")
    model = ml.fit_point("random_forest", {"trees": 7}, encoder, x, classes)
    each = model.transform(df, each_tree=True)
    scored = model.transform(df)
    assert set(each.columns) - set(scored.columns) == {"tree_values"}
    python = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "values(" in python(each) and "values(" not in python(scored) and python(scored).count("ArrowEvalPython") == 1
    out = ["prediction"] + (["probability", "rawPrediction"] if classes else [])
    got = {r.id: r for r in scored.select("id", *out).collect()}
    want = {r.id: r for r in each.select("id", *out, "tree_values").collect()}
    assert len(got) == 300 and all(got[i][c] == want[i][c] for i in want for c in out)
    for i, r in want.items():
        total = 0.0
        for v in r.tree_values:
            total += v
        mean = total / 7
        assert got[i].prediction == (float(mean > 0.5) if classes else mean)
        assert not classes or list(got[i].probability) == [1 - mean, mean]
    assert model.transform(df.where(F.lit(False))).count() == 0
