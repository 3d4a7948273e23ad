"""Segmented scan against a sequential pass."""
import random

import numpy as np
import pytest

from ledgerline.operators import stats


def sequential(rows, gap):
    out, before = [], None
    run = 0
    for key, t, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        same = before is not None and before[0] == key
        prev = before[1] if same else None
        step = int(same and prev is not None and v is not None and abs(v - prev) > gap)
        run = run + step if same else 0
        out.append((i, prev, run))
        before = key, v
    return sorted(out)


def far():
    def breaks(now, before):  # a local function travels to the workers by value
        import pyarrow.compute as pc
        return pc.fill_null(pc.greater(pc.abs(pc.subtract(now["v"], before["v"])), 1.0), False).to_numpy(zero_copy_only=False)
    return breaks


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lag_and_running_count(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        key = rng.choice(["hot"] * 6 + ["a", "b", None, "c"])
        rows.append((key, i * 37 % 1000 + i / 1000, None if rng.random() < 0.1 else round(rng.gauss(0, 1), 2), i))
    df = spark.createDataFrame(rows, "k string, t double, v double, id long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        got = stats.segmented_scan(df, "k", ["t"], ["v"], breaks=far())
        assert got.columns == ["k", "t", "v", "id", "prev_v", "run"]
        assert sorted((r.id, r.prev_v, r.run) for r in got.collect()) == sequential(rows, 1.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_key_many_partitions_and_empty(spark):
    df = spark.range(300).selectExpr("id", "1 AS k", "cast(id % 3 AS double) AS v")
    got = sorted((r.id, r.prev_v, r.run) for r in stats.segmented_scan(df, "k", ["id"], ["v"], breaks=far()).collect())
    assert [g[1] for g in got] == [None] + [float(i % 3) for i in range(299)]
    assert [g[2] for g in got] == list(np.cumsum([int(i > 0 and i % 3 == 0) for i in range(300)]))
    assert stats.segmented_scan(df.limit(0), "k", ["id"], ["v"], breaks=far()).count() == 0
    assert stats.with_previous(df.limit(1), ["k"], ["id"], ["v", "id"]).first().prev_id is None


def test_one_range_exchange(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS k", "id AS v")
    plan = stats.with_previous(df, ["k"], ["id"], ["v"])._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan.split("Physical Plan")[-1]  # read from the written pass
