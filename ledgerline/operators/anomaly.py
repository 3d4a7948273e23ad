"""Anomaly detection on numeric feature columns.

Isolation forest: Spark has no estimator, so every tree gets its own hash
sample of ``sample_size`` rows, grown in one grouped task per tree; the grown
trees (at most 2 * ``sample_size`` nodes each) are broadcast, and every row is
scored inside ``mapInPandas`` with vectorised numpy path lengths.  The robust
elliptic score is Mahalanobis distance under a mean and covariance refitted on
the innermost rows, by aggregations and exact quantiles only.  Missing values
take the column's mean, and every row gets a score.  Thresholds are the exact
(1 − contamination) quantile of the scores.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint

EULER = 0.5772156649


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def fill_means(df: DataFrame, features, key_col: str) -> DataFrame:
    """Key and features as doubles, nulls and NaN replaced by the column's mean (0 if it has none)."""
    x = df.select(key_col, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features])
    means = x.agg(*[F.avg(c).alias(c) for c in features]).first()
    return x.fillna({c: float(means[c] if means[c] is not None else 0.0) for c in features})


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, max_depth: int, nodes: list) -> int:
    idx = len(nodes)
    nodes.append(None)
    if depth >= max_depth or len(x) <= 1 or np.all(x.max(axis=0) == x.min(axis=0)):
        nodes[idx] = (-1, 0.0, -1, -1, _c(len(x)))
        return idx
    spread = np.where(x.max(axis=0) > x.min(axis=0))[0]
    f = int(rng.choice(spread))
    lo, hi = x[:, f].min(), x[:, f].max()
    s = float(rng.uniform(lo, hi))
    left = _grow(x[x[:, f] < s], rng, depth + 1, max_depth, nodes)
    right = _grow(x[x[:, f] >= s], rng, depth + 1, max_depth, nodes)
    nodes[idx] = (f, s, left, right, _c(len(x)))
    return idx


def _path_lengths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = tree[node, 0] >= 0
    while active.any():
        f = tree[node[active], 0].astype(np.int64)
        s = tree[node[active], 1]
        go_left = x[active, f] < s
        nxt = np.where(go_left, tree[node[active], 2], tree[node[active], 3]).astype(np.int64)
        node[active] = nxt
        depth[active] += 1
        active = tree[node, 0] >= 0
    return depth + tree[node, 4]


def _flag(scored: DataFrame, key_col: str, contamination: float) -> DataFrame:
    """Adds ``is_anomaly``; scores are written once and read for the threshold and the flag."""
    scored = reliable_checkpoint(scored)
    thr = stats.exact_quantiles(scored, "anomaly_score", key_col, [1 - contamination], name="_t") \
        .select(F.col("_t")[0].alias("_thr"))
    return scored.crossJoin(F.broadcast(thr)).withColumn("is_anomaly", F.col("anomaly_score") > F.col("_thr")).drop("_thr")


def isolation_forest(df: DataFrame, features, key_col: str, n_trees: int = 100, sample_size: int = 256,
                     contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds anomaly_score (2^(−E[h]/c(ψ)), higher = more anomalous) and
    is_anomaly (score above the exact 1 − contamination quantile)."""
    spark, cols = df.sparkSession, list(features)
    base = reliable_checkpoint(fill_means(df, cols, key_col))
    total = base.count()
    psi = min(sample_size, total)
    if not psi:
        return base.select(key_col, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    # a row is drawn for a tree by a hash of its key and the tree; a few more than ψ, of which the tree keeps ψ
    share = min(1.0, (psi + 6 * math.sqrt(psi) + 6) / total)
    draw = F.pmod(F.xxhash64(F.col(key_col), F.col("tree"), F.lit(seed)), F.lit(1 << 30))
    drawn = (base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("_h", draw)
                 .filter(F.col("_h") < F.lit(int(share * (1 << 30)))))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf):
        import pandas as pd
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["_h", *cols]).head(psi)[cols].to_numpy(dtype=float)
        nodes: list = []
        _grow(x, np.random.default_rng([seed, tree]), 0, max_depth, nodes)
        return pd.DataFrame({"tree": [tree], "nodes": [np.array(nodes, dtype=float).ravel()]})

    # n_trees rows of at most 2 * sample_size nodes
    rows = drawn.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").orderBy("tree").collect()
    shared = spark.sparkContext.broadcast([np.array(r["nodes"]).reshape(-1, 5) for r in rows])
    cpsi = _c(psi)

    def score(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            h = np.mean([_path_lengths(t, x) for t in shared.value], axis=0) if len(x) else np.array([])
            out = pdf[[key_col]].copy()
            out["anomaly_score"] = np.power(2.0, -h / cpsi) if cpsi > 0 else 0.5
            yield out

    key_type = base.schema[key_col].dataType.simpleString()
    return _flag(base.mapInPandas(score, f"{key_col} {key_type}, anomaly_score double"), key_col, contamination)


def _moments(df: DataFrame, features) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and covariance from one aggregation (one row fetched)."""
    k, x = len(features), [F.col(c) for c in features]
    aggs = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*aggs).first()
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[f"_c{i}_{j}"] or 0.0
    return np.array([row[f"_m{i}"] or 0.0 for i in range(k)]), cov


def robust_elliptic(df: DataFrame, features, key_col: str, contamination: float = 0.1, inner: float = 0.75,
                    steps: int = 4, keep=()) -> DataFrame:
    """Mahalanobis distance under a robust mean and covariance; flagged above
    the exact 1 − contamination quantile.

    The fit starts from the coordinates' medians and median absolute
    deviations and then concentrates: the ``inner`` share of rows with the
    smallest distances gives the next mean and covariance, ``steps`` times.
    Outliers up to ``1 - inner`` of the rows do not enter the last fit.
    ``keep``: features that stay in the output."""
    cols = list(features)
    x = reliable_checkpoint(fill_means(df, cols, key_col))
    mid, spread = [], []
    for c in cols:
        m = stats.exact_quantiles(x, c, key_col, [0.5], name="_q").first()
        m = float(m["_q"][0]) if m and m["_q"][0] is not None else 0.0
        dev = x.select(key_col, F.abs(F.col(c) - m).alias("_d"))
        s = stats.exact_quantiles(dev, "_d", key_col, [0.5], name="_q").first()
        mid.append(m)
        spread.append((float(s["_q"][0]) if s and s["_q"][0] else 0.0) * 1.4826)
    mean, cov = np.array(mid), np.diag([v * v if v > 0 else 1.0 for v in spread])

    def distance(mean, cov):
        inv = np.linalg.pinv(cov)
        d = [F.col(c) - float(m) for c, m in zip(cols, mean)]
        q = sum(d[i] * d[j] * float(inv[i, j]) for i in range(len(cols)) for j in range(len(cols)))
        return F.sqrt(F.greatest(q, F.lit(0.0)))

    for _ in range(steps):
        near = x.withColumn("_dist", distance(mean, cov))
        cut = stats.exact_quantiles(near, "_dist", key_col, [inner], name="_q").first()
        if cut is None or cut["_q"][0] is None:
            break
        mean, cov = _moments(near.filter(F.col("_dist") <= float(cut["_q"][0])), cols)
    return _flag(x.select(key_col, *keep, distance(mean, cov).alias("anomaly_score")), key_col, contamination)


def anomaly_records(scored: DataFrame, key_col: str, n: int | None = None) -> DataFrame:
    """The flagged rows of a scored table, most anomalous first; all of them without ``n``."""
    out = scored.filter("is_anomaly").drop("is_anomaly").orderBy(F.desc("anomaly_score"), key_col)
    return out if n is None else out.limit(n)


def anomaly_report(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("records"), F.count_if("is_anomaly").alias("anomalies"),
                      (F.count_if("is_anomaly") / F.count(F.lit(1)) * 100).alias("anomaly_pct"),
                      F.avg(F.when(F.col("is_anomaly"), F.col("anomaly_score"))).alias("mean_anomaly_score"))


def standardize(df: DataFrame, cols) -> DataFrame:
    """z-scores with population standard deviation (one aggregation row)."""
    m = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    x = df.crossJoin(m)
    for c in cols:
        x = x.withColumn(f"{c}_z", F.when(F.col(f"_s_{c}") == 0, 0.0)
                         .otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    return x.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def dbscan_flags(df: DataFrame, features, key_col: str, eps: float = 0.5, min_pts: int = 5) -> DataFrame:
    """DBSCAN core / noise labels (noise = anomaly) without enumerating all
    pairs.

    Points fall into grid cells of side eps/√d, so two points of one cell are
    within eps: a cell holding ≥ min_pts points is all core.  Only points
    of sparse cells (< min_pts points) are paired with the points of the
    (2r+1)^d neighbouring cells (r = ⌈√d⌉), by an equi-join on the cell key.
    Every point of a dense cell meets at most (2r+1)^d · (min_pts − 1) sparse
    points, so the pair count is linear in the input.  A non-core point is
    noise when no core point lies within eps (the neighbour pairs decide)."""
    d = len(features)
    side = eps / math.sqrt(d)
    r = int(math.ceil(math.sqrt(d)))
    x = df.select(key_col, *[F.col(c).cast("double").alias(c) for c in features]) \
          .withColumn("_cell", F.array(*[F.floor(F.col(c) / side).cast("long") for c in features]))
    counts = x.groupBy("_cell").agg(F.count(F.lit(1)).alias("_cn"))
    pts = reliable_checkpoint(x.join(counts, "_cell"))
    offsets = [list(o) for o in itertools.product(range(-r, r + 1), repeat=d)]
    probe = pts.filter(F.col("_cn") < min_pts).select(
        F.col(key_col).alias("_p"), *[F.col(c).alias(f"_p_{c}") for c in features], "_cell",
        F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])).alias("_off"))
    probe = probe.withColumn("_ncell", F.zip_with("_cell", "_off", lambda a, b: a + b)).drop("_cell", "_off")
    others = pts.select(F.col("_cell").alias("_ncell"), F.col(key_col).alias("_q"), F.col("_cn").alias("_qcn"),
                        *[F.col(c).alias(f"_q_{c}") for c in features])
    dist2 = sum(((F.col(f"_p_{c}") - F.col(f"_q_{c}")) ** 2 for c in features), F.lit(0.0))
    pairs = probe.join(others, "_ncell").filter(dist2 <= eps * eps).select("_p", "_q", "_qcn")
    pairs = reliable_checkpoint(pairs)
    sparse_core = pairs.groupBy("_p").agg((F.count(F.lit(1)) >= min_pts).alias("_core"))
    core = pts.select(key_col, "_cn").join(sparse_core.withColumnRenamed("_p", key_col), key_col, "left") \
              .select(key_col, ((F.col("_cn") >= min_pts) | F.coalesce(F.col("_core"), F.lit(False))).alias("is_core"))
    q_core = core.select(F.col(key_col).alias("_q"), F.col("is_core").alias("_q_core"))
    near_core = pairs.join(q_core, "_q").groupBy("_p").agg(F.max(F.col("_q_core").cast("int")).alias("_near"))
    out = core.join(near_core.withColumnRenamed("_p", key_col), key_col, "left")
    return out.select(key_col, "is_core",
                      (~F.col("is_core") & (F.coalesce(F.col("_near"), F.lit(0)) == 0)).alias("is_noise"))
