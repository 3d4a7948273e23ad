"""Nearest-donor imputation against brute force."""
import math
import random

import pytest

from ledgerline.operators import knn


def brute(rows, width, k):
    out = []
    for r in rows:
        new = list(r)
        for t in range(width):
            if r[1 + t] is not None:
                continue
            near = []
            for d in rows:
                if d[1 + t] is None:
                    continue
                common = [i for i in range(width) if r[1 + i] is not None and d[1 + i] is not None]
                if common:
                    total = 0.0
                    for i in common:
                        total += (r[1 + i] - d[1 + i]) ** 2
                    near.append((total * width / len(common), d[0], d[1 + t]))
            own = [d[1 + t] for d in rows if d[1 + t] is not None]
            best = [x[2] for x in sorted(near)[:k]] or own
            new[1 + t] = sum(best) / len(best) if best else None
        out.append(tuple(new))
    return sorted(out)


@pytest.mark.parametrize("cells,receivers,part", [(1024, 4096, 1 << 21), (16, 7, 50)])
def test_matches_brute_force(spark, monkeypatch, cells, receivers, part):
    monkeypatch.setattr(knn, "CELLS", cells)
    monkeypatch.setattr(knn, "RECEIVERS", receivers)
    rng = random.Random(5)
    rows = []
    for i in range(350):
        p = (1.0, 2.0, 3.0) if i % 3 == 0 else tuple(round(rng.gauss(0, 5), 1) for _ in range(3))  # a third of all rows at one point
        rows.append((i, *[None if rng.random() < 0.2 else v for v in p]))
    rows += [(900, None, None, None), (901, None, 1e6, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, a double, b double, c double, cell string").repartition(3)
    got = sorted(tuple(r)[:4] for r in knn.impute_knn(df, ["a", "b", "c"], "id", 5).collect())
    for g, w in zip(got, brute(rows, 3, 5)):
        assert g[0] == w[0] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(g[1:], w[1:])), (g, w)


def test_edges(spark):
    schema = "id long, a double, b double"
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, float("nan"), None), (4, 3.0, None)], schema)
    assert sorted(tuple(r) for r in knn.impute_knn(df, ["a", "b"], "id").collect()) == [(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 2.0, 4.0), (4, 3.0, 4.0)]
    assert knn.impute_knn(df.limit(0), ["a", "b"], "id").count() == 0
    nothing = spark.createDataFrame([(1, None, 1.0)], schema)
    assert tuple(knn.impute_knn(nothing, ["a", "b"], "id").first()) == (1, None, 1.0)
    whole = spark.createDataFrame([(1, 2.0, 1.0)], schema)
    assert tuple(knn.impute_knn(whole, ["a", "b"], "id").first()) == (1, 2.0, 1.0)
