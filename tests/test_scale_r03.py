"""Steps that must not grow faster than their input: forests, term vectors, row packing, describe."""
import numpy as np
import pyarrow as pa
import pytest

from ledgerline.operators import forest, layout, ml, profile, stats
from ledgerline.operators import text as TX


def _rows(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)).round(2)
    y = (x[:, 0] * 2 + x[:, 1]).round(3)
    return spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), "uv"[i % 2], float(y[i])) for i in range(n)],
                                 "id long, a double, b double, c string, label double").repartition(4)


def test_a_large_forest_never_comes_to_the_driver(spark, monkeypatch):
    df = _rows(spark)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 90)
    model = ml.fit_forest(df, ["a", "b"], ["c"], "id", trees=7)
    every = df.unionByName(df.limit(3))  # keys may repeat
    want = sorted((r.id, r.prediction) for r in model.transform(every).collect())
    each = {r.id: r.tree_values for r in model.transform(df, each_tree=True).collect()}
    for name, value in (("MODEL_BYTES", 1), ("SCORE_ROWS", 50), ("SCORE_BLOCK_ROWS", 40), ("BLOCK_ROWS", 20), ("BATCH_BYTES", 100)):
        monkeypatch.setattr(forest, name, value)
    monkeypatch.setattr(forest.Forest, "_fetch", lambda *a: pytest.fail("trees were fetched"))
    assert sorted((r.id, r.prediction) for r in model.transform(every).collect()) == want and len(want) == 403
    assert {r.id: r.tree_values for r in model.transform(df, each_tree=True).collect()} == each
    assert model.transform(df.limit(0)).count() == 0


def test_histograms_have_a_place_a_code():
    """A feature of two codes takes three places (one for missing values), not 256."""
    class Plan:
        value = ({0: {"feature": np.array([-1])}}, {0: [0]})
    edges = [np.array([0.5])] * 5
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([[float(i >> k & 1) for k in range(5)] for i in range(300)]),
                                       pa.array([float(i) for i in range(300)]), pa.array([1.0] * 300)], names=["uid", "x", "y", "w"])
    out = list(forest._histograms(Plan, edges, 1)(forest._blocks(edges)([rows])))
    sums = np.frombuffer(out[0].column(2)[0].as_py()).reshape(5, 3, 4)
    times = forest.bag(np.arange(300), 0, 1)
    assert np.allclose(sums[:, :, 0].sum(axis=1), (times > 0).sum()) and np.allclose(sums[:, :, 2].sum(axis=1), (times * np.arange(300)).sum())


def test_vectors_keep_the_terms_of_queries_and_whole_lengths(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "i long, t string")
    d = spark.createDataFrame([(1, "alpha gamma gamma delta"), (2, "gamma delta")], "i long, t string")
    got = TX._fitted_vectors(q, "i", "t", d, "i", "t").collect()
    assert {(r["_src"], r["_id"], r["term"]) for r in got} == {("q", 1, "alpha"), ("q", 1, "beta"), ("q", 1, "alpha beta"), ("d", 1, "alpha")}
    # alpha 1 (df 2), gamma 2 (df 2), delta 1 (df 2), alpha gamma, gamma gamma 1 (df 1), gamma delta 1 (df 2), of 3 documents
    two, one = np.log(4 / 3) + 1, np.log(4 / 2) + 1
    w = next(r.w for r in got if r["_src"] == "d")
    assert abs(w - two / np.sqrt(3 * two ** 2 + (2 * two) ** 2 + 2 * one ** 2)) < 1e-12


def test_rows_of_words_are_put_together_before_they_are_written(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [(doc, float(x), float(line * 20), None if x == 7 else f"{doc}-{line}-{x}") for doc, lines, n in ((None, 2, 9), (1, 3, 300), (2, 40, 4))
             for line in range(lines) for x in range(n)]
    written = []
    keep = stats.reliable_checkpoint
    monkeypatch.setattr(stats, "reliable_checkpoint", lambda df: written.append(keep(df)) or written[-1])
    df = spark.createDataFrame([words[i] for i in rng.permutation(len(words))], "doc long, x double, y double, t string").repartition(5)
    got = {(r.doc, r.row_id): list(r.cells) for r in layout.gap_rows(df, "doc", "x", "y", "t").collect()}
    want: dict = {}
    for doc, _, y, t in words:
        want.setdefault((doc, int(y // 20)), []).append(t)
    assert got == want
    assert written[0].count() <= len(want) + 2 * 8  # a record a row of words, and what the borders part
    assert layout.gap_rows(df.limit(0), "doc", "x", "y", "t").count() == 0


def test_describe_sorts_nothing(spark, monkeypatch):
    monkeypatch.setattr(stats, "with_global_row_number", lambda *a, **k: pytest.fail("a global sort"))
    v = [None if i % 7 == 0 else float(i * i % 101) for i in range(300)]
    df = spark.createDataFrame([(i, v[i], i % 3, None) for i in range(300)], "id long, v double, k int, n double")
    got = {r.column: r for r in profile.describe(df, ["v", "k", "n"], "id").collect()}
    own = [x for x in v if x is not None]
    assert np.allclose([got["v"].p25, got["v"].p50, got["v"].p75, got["v"]["std"]], [*np.percentile(own, [25, 50, 75]), np.std(own, ddof=1)])
    assert got["v"]["count"] == len(own) and got["k"].p50 == 1.0 and got["n"]["count"] == 0 and got["n"].p50 is None
    assert profile.describe(df.limit(0), ["v"], "id").count() == 0
