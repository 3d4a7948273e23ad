"""Association rules and the greedy budget walk against brute force."""
import itertools
import random

import pandas as pd

from ledgerline.operators import basket, inventory


def test_rules_all_splits(spark):
    tx = [(1, "bread"), (1, "milk"), (2, "bread"), (2, "butter"), (2, "milk"), (3, "milk"), (3, "butter"),
          (3, "milk"), (4, "bread"), (4, "milk"), (4, "butter")]
    lines = basket.basket_lines(spark.createDataFrame(tx, "t int, i string"), "t", "i")
    its = basket.frequent_itemsets(basket.basket_collect(lines), 0.5)
    rules = basket.association_rules(its, "confidence", 0.0).toPandas()
    baskets = {t: {i for tt, i in tx if tt == t} for t, _ in tx}
    n = len(baskets)

    def sup(s):
        return sum(1 for b in baskets.values() if set(s) <= b) / n
    items = sorted({i for _, i in tx})
    exp = set()
    for k in (2, 3):
        for s in itertools.combinations(items, k):
            if sup(s) >= 0.5:
                for r in range(1, k):
                    for a in itertools.combinations(s, r):
                        exp.add((tuple(sorted(a)), tuple(sorted(set(s) - set(a)))))
    got = {(tuple(a), tuple(c)) for a, c in zip(rules["antecedents"], rules["consequents"])}
    assert got == exp
    full = rules[rules["confidence"] >= 1.0]
    assert full["conviction"].isna().all()


def test_budget_walk_matches_sequential_greedy(spark):
    rnd = random.Random(3)
    rows = []
    for t in ("A", "B"):
        for i in range(40):
            rows.append((t, f"{t}{i}", round(rnd.random(), 3), float(rnd.randint(1, 60))))
    df = spark.createDataFrame(rows, "tenant string, item_id string, stockout_risk double, cost_impact double")
    got = inventory.budget_select(df, "tenant", 200.0).toPandas()
    pdf = pd.DataFrame(rows, columns=["tenant", "item_id", "stockout_risk", "cost_impact"])
    for t, g in pdf.groupby("tenant"):
        spent, take = 0.0, []
        for _, r in g.sort_values(["stockout_risk", "cost_impact", "item_id"], ascending=[False, True, True]).iterrows():
            if spent + r.cost_impact <= 200.0:
                spent += r.cost_impact
                take.append(r.item_id)
        assert sorted(got[got.tenant == t]["item_id"]) == sorted(take)


def test_dbscan_matches_brute_force_with_hot_cell(spark):
    import numpy as np
    from ledgerline.operators import anomaly
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(size=(150, 2)) * 1.5, np.zeros((60, 2)), rng.uniform(-6, 6, size=(20, 2))])
    pts = np.round(pts, 6)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r.id: (r.is_core, r.is_noise) for r in anomaly.dbscan_flags(df, ["x", "y"], "id", 0.5, 5).collect()}
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    nb = d2 <= 0.25
    core = nb.sum(1) >= 5
    noise = ~core & ~(nb & core[None, :]).any(1)
    for i in range(len(pts)):
        assert got[i] == (bool(core[i]), bool(noise[i]))
