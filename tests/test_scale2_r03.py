"""Steps that must not grow faster than their input: nearest donors, scores of all pairs, models per key, streams."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import knn, ridge
from ledgerline.operators import text as TX
from ledgerline.streaming import feeds


def _donor_rows(n):
    """Rows of a wide, a narrow and a discrete column, each with gaps."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.uniform(0, 1e5, n), rng.uniform(0, 10, n), rng.integers(0, 4, n)], axis=1).round(2)
    gap = rng.random((n, 3)) < 0.2
    return [(i, *[None if g else float(v) for v, g in zip(r, h)]) for i, (r, h) in enumerate(zip(x, gap))]


@pytest.mark.parametrize("patterns", [32, 1])
def test_a_receiver_searches_few_donors(spark, monkeypatch, patterns):
    """Without the wide column the cells are cut by the others, so a receiver searches a small part of the donors."""
    rows = _donor_rows(1500)
    monkeypatch.setattr(knn, "CELL_ROWS", 10)
    monkeypatch.setattr(knn, "CELLS", 64)
    monkeypatch.setattr(knn, "PATTERNS", patterns)
    work, write = [], knn.reliable_checkpoint

    def note(df):
        out = write(df)
        if "target" in out.columns:
            work.append(out.groupBy("id", "target").count().agg(F.avg("count")).first()[0])
        return out
    monkeypatch.setattr(knn, "reliable_checkpoint", note)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    got = {r[0]: tuple(r) for r in knn.impute_knn(df, ["a", "b", "c"], "id", 3).collect()}
    v = np.array([[np.nan if y is None else y for y in r[1:]] for r in rows])
    for i, t in zip(*np.nonzero(np.isnan(v[:400]))):
        both = ~np.isnan(v) & ~np.isnan(v[i])
        far = np.where(both, (v - v[i]) ** 2, 0).sum(axis=1) * 3 / np.maximum(both.sum(axis=1), 1)
        ok = np.flatnonzero(~np.isnan(v[:, t]) & both.any(axis=1))
        best = ok[np.lexsort((ok, far[ok]))[:3]]
        want = v[best, t].mean() if len(best) else np.nanmean(v[:, t])
        assert math.isclose(got[i][1 + t], want, rel_tol=1e-9, abs_tol=1e-9), (i, t)
    if patterns == 32:
        assert work[0] < 16, work  # of up to 64 cells a family


def test_scores_of_blocks_equal_scores_of_pairs(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("BLOCK_PAIRS", 12), ("BLOCK_TERMS", 20)):
        monkeypatch.setattr(TX, name, value)
    words = [f"word{i}" for i in range(12)]
    text = lambda i, n: " ".join(words[(i * 7 + j * j) % 12] for j in range(n))
    q = spark.createDataFrame([(i, text(i, 3)) for i in range(10)] + [(None, "word1 word2"), (3, "word5"), (90, "unseen"), (91, None)], "item int, t string")
    d = spark.createDataFrame([(i, text(i + 3, i % 9)) for i in range(40)] + [(None, "word2"), (7, "word4"), (99, "other")], "doc long, t string")
    vec = TX._fitted_vectors(q, "item", "t", d, "doc", "t").collect()
    want = {}
    for a in (r for r in vec if r["_src"] == "q"):
        for b in (r for r in vec if r["_src"] == "d" and r["term"] == a["term"]):
            want[a["_id"], b["_id"]] = want.get((a["_id"], b["_id"]), 0) + a["w"] * b["w"]
    got = TX.tfidf_similarity(q, "item", "t", d, "doc", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and got.dtypes[:2] == [("item", "int"), ("doc", "bigint")]
    rows = got.collect()
    assert len(rows) == len(want) and all(math.isclose(want[r["item"], r["doc"]], r.score, rel_tol=1e-9) for r in rows)


def test_models_meet_their_rows_once(spark, monkeypatch):
    """Both results of ``score_per_key`` read written rows: neither joins nor fits again."""
    df = spark.createDataFrame([(k, i % 5, float(i), 2.0 * i + k) for k, n in ((1, 30), (2, 4)) for i in range(n)], "k long, f long, x double, y double")
    scored, failed = ridge.score_per_key(df, ridge.fit_per_key(df, "k", ["x"], "y", F.col("f")), "k", ["x"])
    for t in (scored, failed):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "MapInArrow" not in plan
    assert scored.count() == 30 and failed.count() == 4 and set(failed.columns) == {"k", "f", "x", "y", "error"}


def test_one_solve_for_all_keys():
    """Stacked moments give what each gives alone."""
    rng = np.random.default_rng(2)
    rows = np.concatenate([np.ones((6, 20, 1)), rng.normal(size=(6, 20, 3))], axis=2)
    moments = np.swapaxes(rows, 1, 2) @ rows
    models = ridge.solve(moments, 1.0)
    assert models.shape == (6, 3) and ridge.squared_error(moments, models).shape == (6,)
    for m, w in zip(moments, models):
        assert np.allclose(ridge.solve(m, 1.0), w)


def test_a_stream_takes_many_files_a_batch(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["good bad word", "Great, great problem", "", None, "none here", "fear fails gut"] * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    batches, drain = [], feeds._drain

    def note(query, timeout):
        drain(query, timeout)
        batches.append(len([p for p in query.recentProgress if p["numInputRows"]]))
    monkeypatch.setattr(feeds, "_drain", note)
    got = {r.doc_id: r for r in feeds.stream_sentiment(spark, str(tmp_path)).collect()}
    assert batches == [1] and len(got) == 24
    want = {r.doc_id: r for r in TX.sentiment_scores(spark.createDataFrame(rows, "doc_id long, text string").where("text is not null"), "text").collect()}
    for i, r in want.items():
        assert all(math.isclose(got[i][c], r[c], abs_tol=1e-12) for c in ("neg", "neu", "pos", "compound", "polarity", "subjectivity"))
    assert got[3].compound is None
