"""Streaming analyses (drained with an availableNow trigger), checked
against the same SQL as their batch forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.plans.q_metrics import RATE_LIMIT, RATE_WINDOW
from ledgerline.plans.q_text import _SENT_CTE, phrased
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table
from ledgerline.streaming import feeds


@register("stream_sentiment", sql=_SENT_CTE + """
SELECT doc_id, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos, round(compound, 6) AS compound FROM sc""")
def q_stream_sentiment(spark, d):
    s = feeds.stream_sentiment(spark, d, "documents", "doc_id", "text", phrased("doc_id"))
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("neg", "neu", "pos", "compound")])


@register("stream_rate_window", sql=f"""
SELECT user_id, time_bucket(INTERVAL '{RATE_WINDOW}', ts) AS window_start, count(*) AS requests, count(*) > {RATE_LIMIT} AS breach
FROM events GROUP BY 1, 2""")
def q_stream_rate(spark, d):
    return feeds.stream_rate(spark, d, "events", "ts", "user_id", RATE_WINDOW, RATE_LIMIT)


@register("stream_anomaly")
def q_stream_anomaly(spark, d):
    """Model fitted in batch (mean and covariance of event values and hour),
    then new events are scored by the stream."""
    ev = table(spark, d, "events").withColumn("hour", F.hour("ts").cast("double"))
    mom = ev.agg(F.avg("value").alias("m0"), F.avg("hour").alias("m1"), F.covar_samp("value", "value").alias("c00"),
                 F.covar_samp("value", "hour").alias("c01"), F.covar_samp("hour", "hour").alias("c11")).first()
    inv = np.linalg.pinv(np.array([[mom["c00"], mom["c01"]], [mom["c01"], mom["c11"]]]))
    d0 = F.col("value") - float(mom["m0"])
    d1 = F.hour("ts").cast("double") - float(mom["m1"])
    score = F.sqrt(F.greatest(F.lit(0.0), d0 * d0 * float(inv[0, 0]) + 2 * d0 * d1 * float(inv[0, 1]) + d1 * d1 * float(inv[1, 1])))
    thr = stats.exact_quantiles(ev.select("event_id", score.alias("s")), "s", "event_id", [0.9], "_t").first()["_t"][0]
    out = feeds.stream_scores(spark, d, "events", "event_id", score, score > float(thr))
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("stream_rate_watermarked")
def q_stream_rate_watermarked(spark, d):
    """Production form: append mode with a 10-minute watermark, so window
    state is dropped once a window is final.  Windows still open when the
    drained stream stops are not emitted (rows-only check; the complete-mode
    form above is the batch-equality check)."""
    return feeds.stream_rate_watermarked(spark, d, "events", "ts", "user_id", RATE_WINDOW, RATE_LIMIT, "10 minutes")
