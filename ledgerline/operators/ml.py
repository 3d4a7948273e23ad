"""Model training, scoring and explanation on ``pyspark.ml``.

Feature pipelines are ``Pipeline`` stages (StringIndexer → OneHotEncoder →
VectorAssembler → StandardScaler); rows are encoded once and
candidates compared by cross-validation; forests are grown by
``operators.forest``; everything runs as Spark jobs on partitioned data, the
driver only holds model parameters.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import risk_level
from ledgerline.operators import forest, stats
from ledgerline.session import ensure_checkpoint_dir, reliable_checkpoint

SEED = 42


# ------------------------------------------------------------------ splitting

def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.2) -> DataFrame:
    """Deterministic stratified split: inside each class rows are ordered by
    md5(key) and the last ceil(test_frac·n) go to test.  Class ranks come
    from the range-partitioned global numbering (a class holding most rows
    is still spread over all tasks)."""
    x = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    numbered = stats.with_global_row_number(x, [label, "_h", key], name="_rn")
    bounds = numbered.groupBy(label).agg(F.min("_rn").alias("_start"), F.count(F.lit(1)).alias("_n"))
    j = numbered.join(F.broadcast(bounds), label)   # one row per class
    rk = F.col("_rn") - F.col("_start") + 1
    n_train = F.col("_n") - F.ceil(F.col("_n") * test_frac)
    return j.withColumn("split", F.when(rk <= n_train, "train").otherwise("test")).drop("_h", "_rn", "_start", "_n")


# ------------------------------------------------------------------ metrics helpers

def classification_report(df: DataFrame, label: str, prediction: str, classes=(0, 1)) -> DataFrame:
    cls = F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
    x = df.select(F.col(label).alias("_y"), F.col(prediction).alias("_p"), cls)
    a = x.groupBy("cls").agg(F.count_if(F.col("_y") == F.col("cls")).alias("support"),
                             F.count_if(F.col("_p") == F.col("cls")).alias("_pp"),
                             F.count_if((F.col("_p") == F.col("cls")) & (F.col("_y") == F.col("cls"))).alias("_tp"))
    prec = F.when(F.col("_pp") == 0, 0.0).otherwise(F.col("_tp") / F.col("_pp"))
    rec = F.when(F.col("support") == 0, 0.0).otherwise(F.col("_tp") / F.col("support"))
    return a.select("cls", "support", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec)).alias("f1"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first; the
    cumulative counts use the range-partitioned running sums."""
    y = F.col(label).cast("int")
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(y == 1).alias("_pos"),
                                                          F.count_if(y == 0).alias("_neg"))
    per = per.withColumn("_desc", -F.col("threshold"))
    numbered = stats.with_global_row_number(per, ["_desc"], name="_ord")
    c1 = stats._cumulative_before(numbered, "_ord", "_pos", "_pos_before")
    c2 = stats._cumulative_before(c1.drop("_ll_pid"), "_ord", "_neg", "_neg_before")
    tot = per.agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return c2.crossJoin(tot).select(
        "threshold", ((F.col("_neg_before") + F.col("_neg")) / F.col("_N")).alias("fpr"),
        ((F.col("_pos_before") + F.col("_pos")) / F.col("_P")).alias("tpr"))


# ------------------------------------------------------------------ feature pipelines

def feature_stages(numeric, categorical, scale: bool = True):
    """StringIndexer(keep unknown) → OneHotEncoder → VectorAssembler →
    StandardScaler (centred, as the reference scales)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in categorical]
    ohe = [OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__ohe", handleInvalid="keep") for c in categorical]
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}__ohe" for c in categorical],
                          outputCol="raw_features" if scale else "features", handleInvalid="keep")
    stages = idx + ohe + [asm]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Adds n / (classes · n of the class), so every class weighs the same.
    The label must have few values: one row per value is broadcast, and more
    than 1000 are refused."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError(f"{label} has more than 1000 values")
    total = sum(r["_n"] for r in rows)
    w = counts.select(label, (F.lit(float(total)) / (len(rows) * F.col("_n"))).alias(name))
    return df.join(F.broadcast(w), label)


# The search grids of the three flows, whole (None: no depth limit).
# Where a flow also lists two solvers of one logistic problem, there is one point.
CHURN_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "elasticNetParam": [1.0, 0.0]},
    "random_forest": {"trees": [100, 200], "depth": [None, 10, 20], "min_split": [2, 5], "min_leaf": [1, 2]},
    "gradient_boosting": {"rounds": [100, 200], "step": [0.01, 0.1], "depth": [3, 5], "share": [0.8, 1.0]},
}
PURCHASE_GRIDS = {"random_forest": {"trees": [100], "depth": [None, 10], "min_split": [2, 5]}}
RETENTION_GRIDS = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0]},
    "random_forest": {"trees": [50, 100], "depth": [None, 10, 20]},
    "gradient_boosting": {"rounds": [50, 100], "step": [0.01, 0.1], "depth": [3], "share": [1.0]},
}
# What each model is before a search.
PLAIN = {"logistic_regression": {"C": 1.0, "elasticNetParam": 0.0}, "random_forest": {"trees": 100},
         "gradient_boosting": {"rounds": 100, "step": 0.1, "depth": 3, "share": 1.0}}
FIT_ROWS = 50_000  # rows a partition of an encoded table
FITS_AT_ONCE = 4  # fits of many short jobs that a search runs side by side


class ForestModel:
    """A feature encoder and a grown forest, used like a fitted pipeline."""

    def __init__(self, encoder: PipelineModel, grown: forest.Forest, classes: bool):
        self.encoder, self.forest, self.classes = encoder, grown, classes

    def transform(self, df: DataFrame, each_tree: bool = False) -> DataFrame:
        """Adds ``prediction`` and, for classes, ``probability`` and
        ``rawPrediction``; with ``each_tree`` also ``tree_values``."""
        if each_tree:
            x = self.encoder.transform(df).withColumn("_x", vector_to_array("features"))
            x = self.forest.tree_values(x, "_x").drop("_x")
            mean = F.aggregate("tree_values", F.lit(0.0), lambda a, v: a + v) / F.size("tree_values")
            x = x.withColumn("prediction", mean)
        elif self.forest.size() <= forest.MODEL_BYTES:
            x = self.encoder.transform(df).withColumn("_x", vector_to_array("features"))
            x = self.forest.mean_values(x, "_x", "prediction").drop("_x")
        else:  # only the means travel
            rows = reliable_checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
            coded = self.encoder.transform(rows).select("_row", vector_to_array("features").alias("_x"))
            means = self.forest.row_values(coded, "_x", each=False).withColumnRenamed("_value", "prediction")
            x = self.encoder.transform(rows.join(means, "_row").drop("_row"))
        if self.classes:
            p = F.col("prediction")
            x = x.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("rawPrediction", F.col("probability")) \
                 .withColumn("prediction", (p > 0.5).cast("double"))
        return x


def encode(train: DataFrame, stages: list, key: str) -> tuple[PipelineModel, DataFrame]:
    """The fitted encoder and the encoded rows, written once: every point and fold
    of a search reads them instead of fitting the encoder again."""
    encoder = Pipeline(stages=stages).fit(train)
    x = encoder.transform(train).select(F.col(key).alias("_key"), "label", "features", vector_to_array("features").alias("_x"),
                                        F.col("weight") if "weight" in train.columns else F.lit(1.0).alias("weight"))
    x = reliable_checkpoint(x)
    rows = x.count()
    return encoder, reliable_checkpoint(x.coalesce(max(1, -(-rows // FIT_ROWS))))


def logistic(n_rows: int, point: dict) -> LogisticRegression:
    """``C`` is the inverse strength per row, as in liblinear."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, regParam=1.0 / (point["C"] * max(n_rows, 1)),
                              elasticNetParam=point.get("elasticNetParam", 0.0))


def fit_point(name: str, point: dict, encoder: PipelineModel, x: DataFrame, classes: bool = True):
    """One model of a grid on all encoded rows."""
    if name == "random_forest":
        grown = forest.grow_forest(x, "_key", "_x", "label", point.get("trees", 100), "weight", point.get("depth"),
                                   point.get("min_leaf", 1), point.get("min_split", 2), "sqrt" if classes else "all", SEED)
        return ForestModel(encoder, grown, classes)
    if name == "gradient_boosting":
        est = boosting(point)
    else:
        est = logistic(x.count(), point)
    return PipelineModel(stages=[*encoder.stages, est.fit(x)])


def search(name: str, grid: dict, x: DataFrame, folds: int, metric: str) -> dict:
    """The best point of a grid by cross-validation over all encoded rows: a small
    table goes whole to every task, the fits of a larger one are distributed."""
    if x.count() <= forest.SEARCH_ROWS:
        rows = forest.draw_sample(x, "_key", "_x", "label", "weight", folds)
        return forest.best_point(x.sparkSession, name, grid, rows, folds, metric, SEED)[0]
    return forest.pick_point(name, grid, held_out_scores(name, grid, x, folds), metric)[0]


def held_out_scores(name: str, grid: dict, x: DataFrame, folds: int) -> DataFrame:
    """Written (point, fold, row, y, value) of every row and point, by a model fitted on
    all rows of the other folds; folds are dealt within each label by a hash of the key."""
    numbered = stats.with_global_row_number(x.withColumn("_h", F.xxhash64(F.xxhash64("_key"))), ["label", "_h", "_key"], name="_row")
    x = reliable_checkpoint(numbered.drop("_h").withColumn("_fold", F.pmod("_row", F.lit(folds)).cast("int")))
    size = {r["_fold"]: r["count"] for r in x.groupBy("_fold").count().collect()}
    n = sum(size.values())
    edges = forest.bin_edges(x, "_x", x.select(F.size("_x").alias("n")).first().n) if name == "random_forest" else None

    def unit(fit: dict, points: list, k: int) -> list[DataFrame]:
        own, held = x.where(F.col("_fold") != k), x.where(F.col("_fold") == k)
        out = lambda i, row, value: row.select(F.lit(i).alias("point"), F.lit(k).alias("fold"), F.col("_row").alias("row"),
                                               F.col("label").cast("int").alias("y"), value.alias("value"))
        if name == "random_forest":
            depths = [p.get("depth") for _, p in points]
            grown = forest.grow_forest(own, "_key", "_x", "label", max(p["trees"] for _, p in points), "weight",
                                       None if None in depths else max(depths), fit.get("min_leaf", 1), fit.get("min_split", 2), "sqrt", SEED + k, edges)
            means = grown.point_values(held, "_x", [(p["trees"], p.get("depth")) for _, p in points])
            means = reliable_checkpoint(held.select("_row", "label").join(means, "_row"))
            return [out(i, means, F.col("_value")[j]) for j, (i, _) in enumerate(points)]
        raw = vector_to_array("rawPrediction")[1]
        if name == "gradient_boosting":
            model = boosting({**fit, "rounds": max(p["rounds"] for _, p in points)}).fit(own)
            return [reliable_checkpoint(out(i, first_rounds(model, p["rounds"]).transform(held), raw)) for i, p in points]
        model = logistic(n - size.get(k, 0), fit).fit(own)
        return [reliable_checkpoint(out(i, model.transform(held), raw)) for i, _ in points]

    units = [(fit, points, k) for fit, points in forest._fits(name, grid) for k in sorted(size)]
    if name == "random_forest":  # each fills the cluster
        parts = [unit(*u) for u in units]
    else:  # many short jobs each
        with ThreadPool(FITS_AT_ONCE) as pool:
            parts = pool.map(inheritable_thread_target(x.sparkSession)(lambda u: unit(*u)), units, 1)
    return reduce(DataFrame.unionByName, [p for part in parts for p in part])


def boosting(point: dict) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=point["rounds"], stepSize=point["step"], maxDepth=point["depth"],
                         subsamplingRate=point["share"], seed=SEED)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model as it was after ``rounds`` rounds."""
    own, context = model._java_obj, SparkContext._active_spark_context
    trees, jvm = own.trees(), context._jvm
    first = context._gateway.new_array(getattr(jvm, "org.apache.spark.ml.regression.DecisionTreeRegressionModel"), rounds)
    weights = context._gateway.new_array(jvm.double, rounds)
    for i in range(rounds):
        first[i], weights[i] = trees[i], model.treeWeights[i]
    cut = getattr(jvm, "org.apache.spark.ml.classification.GBTClassificationModel")(own.uid(), first, weights)
    own.copyValues(cut, own.extractParamMap())
    return GBTClassificationModel(cut)


METRICS = "model string, auc double, accuracy double, precision double, recall double, f1 double, selected boolean"


def _table(spark, rows: list[dict], best: str) -> DataFrame:
    names = [x.split()[0] for x in METRICS.split(", ")]
    return spark.createDataFrame([tuple({**r, "selected": r["model"] == best}[n] for n in names) for r in rows], METRICS)


def fold_count(x: DataFrame, most: int = 5) -> int:
    """As many folds as the smallest class allows, 2 to ``most``."""
    return max(2, min(most, *[r["count"] for r in x.groupBy("label").count().collect()]))


def train_classifiers(train: DataFrame, test: DataFrame, numeric, categorical, key: str, grids: dict, metric: str = "auc", only=None):
    """Grid search with cross-validation (up to 5 folds) for each model, by
    ``metric`` (auc or f1); the best point of each is fitted on all rows.
    Returns the metric table over the held-out rows with the chosen model
    flagged, and that model."""
    encoder, x = encode(train, feature_stages(numeric, categorical), key)
    folds, rows, best = fold_count(x), [], None
    for name in only or grids:
        model = fit_point(name, search(name, grids[name], x, folds, metric), encoder, x)
        rows.append({**_binary_metrics(model.transform(test)), "model": name})
        if best is None or rows[-1][metric] > best[0]:
            best = rows[-1][metric], name, model
    return _table(train.sparkSession, rows, best[1]), best[2]


def train_and_refine(train: DataFrame, test: DataFrame, numeric, categorical, key: str, k: int = 10, grids: dict | None = None):
    """Class-balanced models on the ``k`` best features (ANOVA F), the one with
    the highest F1 on the held-out rows refined by a 3-fold grid search on F1.
    Returns the metric table (a row ``refined <model>`` is the chosen one) and
    the refined model."""
    grids, rows, best = grids or RETENTION_GRIDS, [], None
    stages = feature_stages(numeric, categorical)
    stages[-1].setOutputCol("all_features")
    pick = UnivariateFeatureSelector(featuresCol="all_features", outputCol="features", labelCol="label", selectionMode="numTopFeatures")
    pick.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    encoder, x = encode(balanced_weights(train), [*stages, pick], key)
    for name in grids:
        model = fit_point(name, PLAIN[name], encoder, x)
        rows.append({**_binary_metrics(model.transform(test)), "model": name})
        if best is None or rows[-1]["f1"] > best[0]:
            best = rows[-1]["f1"], name
    name = best[1]
    refined = fit_point(name, search(name, grids[name], x, 3, "f1"), encoder, x)
    rows.append({**_binary_metrics(refined.transform(test)), "model": f"refined {name}"})
    return _table(train.sparkSession, rows, rows[-1]["model"]), refined


def _binary_metrics(pred: DataFrame) -> dict:
    """Metric values of one model: a single aggregation row (bounded)."""
    auc = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC").evaluate(pred)
    m = stats.classification_metrics(pred.withColumn("_p", F.col("prediction").cast("int")), "label", "_p").first()
    return {"auc": float(auc), "accuracy": float(m["accuracy"]), "precision": float(m["precision"]),
            "recall": float(m["recall"]), "f1": float(m["f1"])}


def score_binary(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    p = model.transform(df)
    prob = vector_to_array("probability")[1]
    return p.select(id_col, prob.alias("probability"), (prob >= 0.5).cast("int").alias("predicted"),
                    risk_level(prob).alias("risk_level"))


def prediction_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total"), F.sum("predicted").alias("positives"),
                      F.round(F.avg("predicted"), 4).alias("rate"), F.round(F.avg("probability"), 2).alias("mean_probability"))


def feature_names(model: PipelineModel, df: DataFrame, col: str = "features") -> list:
    """Encoded feature names from the ml_attr metadata of the assembled vector."""
    out = model.transform(df.limit(1))
    meta = out.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    if not meta and "raw_features" in out.columns:
        # a scaler keeps the order of the assembled vector but drops its names
        meta = out.schema["raw_features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    return [names[i] for i in sorted(names)]


def feature_importance(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """(feature, importance) with the correct encoded names: tree
    importances, or |coefficient| for linear models."""
    if isinstance(model, ForestModel):
        names, vals = feature_names(model.encoder, df), model.forest.importances()
    else:
        last = model.stages[-1]
        names = feature_names(PipelineModel(stages=model.stages[:-1]), df)
        vals = last.featureImportances.toArray() if hasattr(last, "featureImportances") else \
            [abs(x) for x in last.coefficients.toArray()]
    spark = df.sparkSession
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    t = spark.createDataFrame(rows, "feature string, importance double")
    return t.orderBy(F.desc("importance"), "feature").limit(top)


def explain_linear(model: PipelineModel, df: DataFrame, id_col: str, top: int = 5) -> DataFrame:
    """Linear attributions coef_j · (x_j − mean_j) on the model's (already
    standardised, so mean 0) features; top ``top`` by |impact| per row."""
    lr = model.stages[-1]
    coefs = [float(c) for c in lr.coefficients.toArray()]
    names = feature_names(PipelineModel(stages=model.stages[:-1]), df)
    feats = PipelineModel(stages=model.stages[:-1]).transform(df)
    arr = vector_to_array("features")
    impacts = F.array(*[F.struct(F.abs(arr[i] * coefs[i]).alias("abs_impact"), F.lit(names[i]).alias("feature"),
                                 (arr[i] * coefs[i]).alias("impact")) for i in range(len(coefs))])
    top_k = F.slice(F.sort_array(impacts, asc=False), 1, top)
    return feats.select(id_col, F.posexplode(top_k).alias("rank", "f")) \
                .select(id_col, (F.col("rank") + 1).alias("rank"), "f.feature", "f.impact",
                        F.when(F.col("f.impact") >= 0, "increases").otherwise("decreases").alias("direction"))


def what_if(model: PipelineModel, df: DataFrame, id_col: str, numeric, categorical) -> DataFrame:
    """Scenario table: every row × (each numeric feature × {0.8, 1.2}, each
    categorical feature → 'Other') with Δ probability against the row's own
    score.  The base score is a column before the rows are multiplied, so
    nothing is joined."""
    prob = vector_to_array("probability")[1]
    base = model.transform(df).select(*df.columns, prob.alias("base_probability"))
    scen = []
    for c in numeric:
        for f in (0.8, 1.2):
            scen.append(F.struct(F.lit(c).alias("feature"), F.lit(f"x{f}").alias("change")))
    for c in categorical:
        scen.append(F.struct(F.lit(c).alias("feature"), F.lit("Other").alias("change")))
    x = base.withColumn("_s", F.explode(F.array(*scen)))
    for c in numeric:
        x = x.withColumn(c, F.when(F.col("_s.feature") == c,
                                   F.col(c) * F.when(F.col("_s.change") == "x0.8", 0.8).otherwise(1.2)).otherwise(F.col(c)))
    for c in categorical:
        x = x.withColumn(c, F.when(F.col("_s.feature") == c, F.lit("Other")).otherwise(F.col(c)))
    return model.transform(x).select(id_col, F.col("_s.feature").alias("feature"), F.col("_s.change").alias("change"),
                                     prob.alias("probability"), "base_probability",
                                     (prob - F.col("base_probability")).alias("delta"))


def top_factors(model: PipelineModel, df: DataFrame, id_col: str, top: int = 5) -> DataFrame:
    """Per row the ``top`` linear attributions, as 'feature:impact' joined by '; '."""
    parts = explain_linear(model, df, id_col, top).withColumn(
        "f", F.concat_ws(":", "feature", F.format_number("impact", 3)))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "f"))),
                                                              lambda x: x["f"]), "; ").alias("factors"))


def fit_forest(train: DataFrame, numeric, categorical, key: str, trees: int = 100) -> ForestModel:
    """A regression forest of unlimited trees over unscaled features."""
    encoder, x = encode(train, feature_stages(numeric, categorical, scale=False), key)
    return fit_point("random_forest", {"trees": trees}, encoder, x, classes=False)


def regressors():
    return {
        "linear_regression": LinearRegression(featuresCol="features", labelCol="label", regParam=0.0),
        "elastic_net": LinearRegression(featuresCol="features", labelCol="label", regParam=0.1, elasticNetParam=0.5,
                                        standardization=False),
        "random_forest": None,  # grown by ``forest``
        "gradient_boosting": GBTRegressor(featuresCol="features", labelCol="label", maxIter=100, maxDepth=3, seed=SEED),
    }


def train_regressors(train: DataFrame, test: DataFrame, numeric, categorical, key: str):
    """Fit each regressor on rows encoded once, evaluate RMSE / MAE / R² on the
    held-out rows, select the lowest RMSE."""
    rows, best, best_rmse = [], None, math.inf
    encoder, x = encode(train, feature_stages(numeric, categorical), key)
    for name, est in regressors().items():
        model = fit_point(name, {}, encoder, x, classes=False) if est is None else PipelineModel(stages=[*encoder.stages, est.fit(x)])
        m = stats.regression_metrics(model.transform(test), "label", "prediction").first()
        rows.append((name, m["rmse"], m["mae"], m["r2"]))
        if m["rmse"] < best_rmse:
            best, best_rmse = model, m["rmse"]
    t = train.sparkSession.createDataFrame([(*r, r[1] == best_rmse) for r in rows],
                                           "model string, rmse double, mae double, r2 double, selected boolean")
    return t, best


def save_model(model: PipelineModel, name: str, spark) -> str:
    """Persist a fitted pipeline under the shared checkpoint folder, each time in a place of its own."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/models/{name}-{uuid.uuid4().hex}"
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
