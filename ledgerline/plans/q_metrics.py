"""Evaluation metrics, autocorrelation, rate windows and the deterministic
split, bound to the driver tables.

Classification: label = labels.quality, rule prediction = document longer
than 1,500 characters, score = document length.  Regression: event value
against the user's mean value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import ml, stats
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table
from ledgerline.streaming import rate

RATE_WINDOW = "1 hour"
RATE_LIMIT = 2


def scored_labels(spark, d):
    lb = table(spark, d, "labels").select("doc_id", "quality")
    dc = table(spark, d, "documents").select("doc_id", "n_chars")
    j = lb.join(dc, "doc_id")
    return j.select("doc_id", F.col("quality").alias("label"),
                    F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("prediction"),
                    F.col("n_chars").cast("double").alias("score"))


_SCORED = """(SELECT l.doc_id, quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction,
        CAST(n_chars AS DOUBLE) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@register("confusion_matrix", sql=f"SELECT label, prediction, count(*) AS count FROM {_SCORED} GROUP BY 1, 2")
def q_confusion(spark, d):
    s = scored_labels(spark, d)
    return s.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


@register("classification_metrics", sql=f"""
WITH c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
           FROM {_SCORED}),
m AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM m""")
def q_classification_metrics(spark, d):
    m = stats.classification_metrics(scored_labels(spark, d), "label", "prediction")
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("classification_report", sql=f"""
SELECT cls, count(*) FILTER (WHERE label = cls) AS support,
       round(CASE WHEN count(*) FILTER (WHERE prediction = cls) = 0 THEN 0.0
                  ELSE count(*) FILTER (WHERE prediction = cls AND label = cls) / count(*) FILTER (WHERE prediction = cls) END, 6) AS precision,
       round(CASE WHEN count(*) FILTER (WHERE label = cls) = 0 THEN 0.0
                  ELSE count(*) FILTER (WHERE prediction = cls AND label = cls) / count(*) FILTER (WHERE label = cls) END, 6) AS recall
FROM {_SCORED}, (SELECT unnest([0, 1]) AS cls) GROUP BY cls""")
def q_classification_report(spark, d):
    return ml.classification_report(scored_labels(spark, d), "label", "prediction") \
        .select("cls", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("roc_auc", sql=f"""
WITH s AS (SELECT score, count(*) AS c, count(*) FILTER (WHERE label = 1) AS pos FROM {_SCORED} GROUP BY score),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS midrank FROM s),
a AS (SELECT sum(midrank * pos) AS rs, sum(pos) AS p, sum(c) - sum(pos) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM a""")
def q_roc_auc(spark, d):
    a = stats.roc_auc(scored_labels(spark, d), "label", "score")
    return a.select(F.round("auc", 6).alias("auc"), F.col("positives").cast("long"), F.col("negatives").cast("long"))


@register("roc_curve", sql=f"""
WITH s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {_SCORED} GROUP BY score),
t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM s)
SELECT score AS threshold,
       round(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / n, 6) AS fpr,
       round(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / p, 6) AS tpr
FROM s, t""")
def q_roc_curve(spark, d):
    c = ml.roc_curve(scored_labels(spark, d), "label", "score")
    return c.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("regression_metrics", sql="""
WITH p AS (SELECT value AS y, avg(value) OVER (PARTITION BY user_id) AS yhat, avg(value) OVER () AS ybar FROM events)
SELECT count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(avg(abs(y - yhat)), 6) AS mae,
       round(1 - sum((y - yhat) * (y - yhat)) / sum((y - ybar) * (y - ybar)), 6) AS r2 FROM p""")
def q_regression_metrics(spark, d):
    e = table(spark, d, "events")
    means = e.groupBy("user_id").agg(F.avg("value").alias("yhat"))
    p = e.join(means, "user_id").select(F.col("value").alias("y"), "yhat")
    r = stats.regression_metrics(p, "y", "yhat")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


@register("acf_seasonality", sql="""
WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1, 2),
p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t, x FROM s),
m AS (SELECT event_type, avg(x) AS m, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT p.event_type, t, x - m AS d, n FROM p JOIN m ON p.event_type = m.event_type),
den AS (SELECT event_type, sum(d * d) AS den, max(n) AS n FROM c GROUP BY 1),
num AS (SELECT a.event_type, l.lag, sum(a.d * b.d) AS num FROM c a CROSS JOIN range(1, 8) l(lag)
        JOIN c b ON b.event_type = a.event_type AND b.t = a.t - l.lag GROUP BY 1, 2)
SELECT num.event_type, CAST(lag AS INTEGER) AS lag, n, round(num / den, 6) AS acf FROM num JOIN den ON num.event_type = den.event_type""")
def q_acf(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("x"))
    a = stats.acf(daily, "event_type", "day", "x", 7)
    return a.select("event_type", "lag", "n", F.round("acf", 6).alias("acf"))


@register("rate_window", sql=f"""
SELECT user_id, time_bucket(INTERVAL '{RATE_WINDOW}', ts) AS window_start, count(*) AS requests, count(*) > {RATE_LIMIT} AS breach
FROM events GROUP BY 1, 2""")
def q_rate_window(spark, d):
    return rate.rate_counts(table(spark, d, "events"), "ts", "user_id", RATE_WINDOW, RATE_LIMIT)


@register("split_train_test", sql="""
SELECT doc_id, quality, CASE WHEN rk <= n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk,
             count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def q_split(spark, d):
    s = ml.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.2)
    return s.select("doc_id", "quality", "split")
