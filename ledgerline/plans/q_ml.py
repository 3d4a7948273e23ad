"""Model analyses (rows-only checks: model fits have no SQL equivalent).

Churn: customers whose last order is more than a year before the latest
order date; features from their order history and account.  Quality:
labels.quality over text features of the labelled documents.  Order value
regression: o_totalprice from the lines of the order.  Anomalies: line
items (quantity, price, discount)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import anomaly, ml, stats
from ledgerline.operators import text as TX
from ledgerline.plans.registry import register
from ledgerline.session import reliable_checkpoint
from ledgerline.sources.tables import table

CHURN_NUM = ["c_acctbal", "n_orders", "avg_order", "total_spend"]
CHURN_CAT = ["c_mktsegment"]


def churn_frame(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    last = o.agg(F.max("o_orderdate").alias("_end"))
    per = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("_last"), F.count(F.lit(1)).alias("n_orders"),
                                     F.avg("o_totalprice").alias("avg_order"), F.sum("o_totalprice").alias("total_spend"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = c.join(per, c.c_custkey == per.o_custkey).crossJoin(last)
    label = (F.datediff(F.to_date("_end"), F.to_date("_last")) > 365).cast("double")
    return j.select(F.col("c_custkey").alias("customer_id"), *CHURN_NUM, *CHURN_CAT, label.alias("label"))


def _split(df, key):
    # materialised once: model fitting passes over the data many times
    s = reliable_checkpoint(ml.stratified_split(df, "label", key, 0.2))
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


@register("churn_train")
def q_churn_train(spark, d):
    train, test = _split(churn_frame(spark, d), "customer_id")
    t, _ = ml.train_classifiers(train, test, CHURN_NUM, CHURN_CAT, "customer_id", ml.CHURN_GRIDS)
    return t.select("model", *[F.round(c, 4).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")], "selected")


def _churn_lr(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    df = churn_frame(spark, d)
    pipe = Pipeline(stages=ml.feature_stages(CHURN_NUM, CHURN_CAT)
                    + [LogisticRegression(featuresCol="features", labelCol="label", maxIter=50)])
    return pipe.fit(df), df


@register("churn_score")
def q_churn_score(spark, d):
    model, df = _churn_lr(spark, d)
    s = ml.score_binary(model, df, "customer_id")
    return s.withColumn("probability", F.round("probability", 4))


@register("prediction_summary")
def q_prediction_summary(spark, d):
    model, df = _churn_lr(spark, d)
    return ml.prediction_summary(ml.score_binary(model, df, "customer_id"))


@register("feature_importance")
def q_feature_importance(spark, d):
    df = churn_frame(spark, d)
    encoder, x = ml.encode(df, ml.feature_stages(CHURN_NUM, CHURN_CAT, scale=False), "customer_id")
    model = ml.fit_point("random_forest", ml.PLAIN["random_forest"], encoder, x)
    return ml.feature_importance(model, df, 20).withColumn("importance", F.round("importance", 4))


@register("explain_linear")
def q_explain_linear(spark, d):
    model, df = _churn_lr(spark, d)
    return ml.explain_linear(model, df, "customer_id", 5).withColumn("impact", F.round("impact", 4))


@register("what_if")
def q_what_if(spark, d):
    model, df = _churn_lr(spark, d)
    w = ml.what_if(model, df, "customer_id", CHURN_NUM, CHURN_CAT)
    return w.select("customer_id", "feature", "change", F.round("delta", 4).alias("delta"))


@register("model_save_load")
def q_model_save_load(spark, d):
    model, df = _churn_lr(spark, d)
    path = ml.save_model(model, "churn_logistic", spark)
    return ml.score_binary(ml.load_model(path), df, "customer_id").withColumn("probability", F.round("probability", 4))


# ---------------------------------------------------------------- quality model over text features

QUAL_NUM = ["n_chars", "word_count", "compound", "pos", "neg"]
QUAL_CAT = ["lang"]


def quality_frame(spark, d, labelled: bool = True):
    """Text features of the labelled documents, or of all (label null where there is none)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    lb = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    x = docs.join(lb, "doc_id", "inner" if labelled else "left").withColumn("word_count", F.size(F.split("text", r"\s+")))
    return TX.sentiment_scores(x, "text").withColumn("n_chars", F.col("n_chars").cast("double"))


@register("purchase_train")
def q_purchase_train(spark, d):
    train, test = _split(quality_frame(spark, d), "doc_id")
    t, _ = ml.train_classifiers(train, test, QUAL_NUM, QUAL_CAT, "doc_id", ml.PURCHASE_GRIDS, metric="f1")
    return t.select("model", *[F.round(c, 4).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")], "selected")


@register("purchase_score")
def q_purchase_score(spark, d):
    """Every document scored by the forest tuned on F1 over the labelled ones."""
    train, test = _split(quality_frame(spark, d), "doc_id")
    _, best = ml.train_classifiers(train, test, QUAL_NUM, QUAL_CAT, "doc_id", ml.PURCHASE_GRIDS, metric="f1")
    s = ml.score_binary(best, quality_frame(spark, d, labelled=False), "doc_id")
    return s.withColumn("probability", F.round("probability", 4))


@register("retention_train")
def q_retention_train(spark, d):
    train, test = _split(quality_frame(spark, d), "doc_id")
    t, refined = ml.train_and_refine(train, test, QUAL_NUM, QUAL_CAT, "doc_id")
    top = ml.feature_importance(refined, ml.balanced_weights(train), 10)
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))),
                                           lambda x: F.concat_ws(":", x["feature"], F.format_number(-x["i"], 4))), "; ").alias("top_features"))
    return t.crossJoin(top).select("model", *[F.round(c, 4).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")], "selected",
                                   F.when(F.col("selected"), F.col("top_features")).alias("top_features"))


# ---------------------------------------------------------------- regression (order value / price)

def order_frame(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("avg_discount"), F.avg("l_tax").alias("avg_tax"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return j.select("o_orderkey", "n_lines", "qty", "avg_discount", "avg_tax", "o_orderpriority",
                    F.col("o_totalprice").alias("label"))


def salary_model(train):
    return ml.fit_forest(train, ["n_lines", "qty", "avg_discount", "avg_tax"], ["o_orderpriority"], "o_orderkey")


@register("salary_train")
def q_salary_train(spark, d):
    df = order_frame(spark, d).withColumn("_bucket", F.pmod(F.xxhash64("o_orderkey"), F.lit(5)))
    train, test = df.filter("_bucket <> 0"), df.filter("_bucket = 0")
    model = salary_model(train)
    pred = reliable_checkpoint(model.transform(test).select("o_orderkey", "label", "prediction"))
    r2 = stats.regression_metrics(pred, "label", "prediction").first()["r2"]
    return pred.select("o_orderkey", F.round("prediction", 2).alias("prediction"), F.lit(round(r2, 4)).alias("r2"))


@register("salary_score")
def q_salary_score(spark, d):
    """Every order priced by the forest fitted on the training orders."""
    df = order_frame(spark, d)
    return salary_model(df.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(5)) != 0)).transform(df) \
        .select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register("pricing_model")
def q_pricing_model(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", F.col("p_retailprice").alias("label"))
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("sales"),
                                                              F.avg("l_discount").alias("avg_discount"))
    df = part.join(li, part.p_partkey == li.l_partkey, "left").fillna({"sales": 0.0, "avg_discount": 0.0}) \
             .withColumn("p_size", F.col("p_size").cast("double")) \
             .withColumn("_bucket", F.pmod(F.xxhash64("p_partkey"), F.lit(5)))
    train, test = df.filter("_bucket <> 0"), df.filter("_bucket = 0")
    t, _ = ml.train_regressors(train, test, ["p_size", "sales", "avg_discount"], ["p_brand", "p_type"], "p_partkey")
    return t.select("model", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")], "selected")


# ---------------------------------------------------------------- anomalies

ANOM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def line_features(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), *ANOM_FEATURES)


@register("anomaly_iforest")
def q_anomaly_iforest(spark, d):
    s = anomaly.isolation_forest(line_features(spark, d), ANOM_FEATURES, "line_id", n_trees=50)
    return s.withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("anomaly_ocsvm")
def q_anomaly_elliptic(spark, d):
    s = anomaly.robust_elliptic(line_features(spark, d), ANOM_FEATURES, "line_id")
    return s.withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("anomaly_report", sql="""
SELECT count(*) AS records, count(*) // 10 AS anomalies, round(100.0 * (count(*) // 10) / count(*), 4) AS anomaly_pct FROM lineitem""")
def q_anomaly_report(spark, d):
    """The flag share equals the contamination (scores have no ties at the threshold)."""
    x = line_features(spark, d)
    s = anomaly.robust_elliptic(x, ANOM_FEATURES, "line_id")
    return anomaly.anomaly_report(s).select("records", "anomalies", F.round("anomaly_pct", 4).alias("anomaly_pct"))


@register("anomaly_records")
def q_anomaly_records(spark, d):
    s = anomaly.robust_elliptic(line_features(spark, d), ANOM_FEATURES, "line_id", keep=ANOM_FEATURES)
    return anomaly.anomaly_records(s, "line_id").withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("standardize", sql="""
SELECT event_id, round(CASE WHEN stddev_pop(value) OVER () = 0 THEN 0.0
                       ELSE (value - avg(value) OVER ()) / stddev_pop(value) OVER () END, 6) AS value_z FROM events""")
def q_standardize(spark, d):
    z = anomaly.standardize(table(spark, d, "events").select("event_id", "value"), ["value"])
    return z.select("event_id", F.round("value_z", 6).alias("value_z"))


def _event_points(spark, d):
    """Events as 2-d points: value and hour of day, z-scored and rounded to
    6 places (population standard deviation)."""
    ev = table(spark, d, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    z = anomaly.standardize(ev, ["value", "hour"])
    return z.select("event_id", F.round("value_z", 6).alias("x"), F.round("hour_z", 6).alias("y"))


@register("anomaly_dbscan", sql="""
WITH e AS (SELECT event_id, value AS v, CAST(hour(ts) AS DOUBLE) AS h FROM events),
z AS (SELECT event_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS x,
             round((h - avg(h) OVER ()) / stddev_pop(h) OVER (), 6) AS y FROM e),
nb AS (SELECT a.event_id AS p, b.event_id AS q FROM z a JOIN z b
       ON b.x BETWEEN a.x - 0.5 AND a.x + 0.5 AND b.y BETWEEN a.y - 0.5 AND a.y + 0.5
       WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
core AS (SELECT p AS event_id, count(*) >= 5 AS is_core FROM nb GROUP BY p),
near AS (SELECT nb.p AS event_id, max(CAST(c.is_core AS INTEGER)) AS near FROM nb JOIN core c ON c.event_id = nb.q GROUP BY nb.p)
SELECT core.event_id, core.is_core, NOT core.is_core AND near.near = 0 AS is_noise FROM core JOIN near ON near.event_id = core.event_id""")
def q_anomaly_dbscan(spark, d):
    return anomaly.dbscan_flags(_event_points(spark, d), ["x", "y"], "event_id", 0.5, 5)
