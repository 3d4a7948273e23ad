"""Recency / frequency / monetary segmentation.

Plan shape: one ``groupBy(customer)`` with map-side partial aggregation, then
the per-customer table (one row per customer, far smaller than the
transactions) is checkpointed once and ranked three ways with the range-
partitioned global numbering from ``stats``.  Nothing is collected.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint

# Segment name for each RFM code (R*100 + F*10 + M).
SEGMENT_CODES = {
    "Champions": [444, 443, 434, 344],
    "Loyal Customers": [442, 441, 433, 432, 342, 341],
    "Potential Loyalists": [431, 421, 424, 423, 333, 332, 331, 324, 323],
    "Recent Customers": [412, 413, 414, 411, 422],
    "Promising": [314, 313, 312, 311],
    "Need Attention": [234, 233, 232, 231, 224, 223, 222, 221],
    "About to Sleep": [134, 133, 132, 131, 124, 123, 122, 121],
    "At Risk": [244, 243, 242, 241],
    "Can't Lose Them": [144, 143, 142, 141],
    "Hibernating": [334, 321, 214, 213, 212, 211],
    "Lost": [114, 113, 112, 111],
}
# Codes without a name fall back on R+F+M: > 9 High Value, > 6 Medium Value, else Low Value.


def segment_map_expr():
    pairs = [(code, name) for name, codes in SEGMENT_CODES.items() for code in codes]
    return F.create_map(*chain.from_iterable((F.lit(c), F.lit(n)) for c, n in pairs))


def rfm_metrics(tx: DataFrame, customer_col: str, date_col: str, amount_col: str,
                analysis_date=None, money_scale: int = 2) -> DataFrame:
    """Per customer: recency (whole days from the last purchase to the
    analysis date; default = latest date + 1 day), frequency (row count) and
    monetary (sum, rounded to ``money_scale`` places so ranking is stable).
    Rows with a null customer or date are dropped."""
    clean = tx.select(F.col(customer_col).alias("customer_id"),
                      F.col(date_col).cast("timestamp_ntz").alias("_d"),
                      F.coalesce(F.col(amount_col).cast("double"), F.lit(0.0)).alias("_a")) \
              .filter(F.col("customer_id").isNotNull() & F.col("_d").isNotNull())
    per = clean.groupBy("customer_id").agg(
        F.max("_d").alias("last_purchase"),
        F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("_a"), money_scale).alias("monetary"))
    if analysis_date is None:
        # latest purchase overall = max of the per-customer maxima (1 row)
        ad = per.agg((F.max("last_purchase") + F.expr("INTERVAL 1 DAY")).alias("_ad"))
    else:
        ad = per.sparkSession.range(1).select(F.lit(analysis_date).cast("timestamp_ntz").alias("_ad"))
    secs = F.unix_timestamp(F.col("_ad").cast("timestamp")) - F.unix_timestamp(F.col("last_purchase").cast("timestamp"))
    return per.crossJoin(ad).select(
        "customer_id", F.floor(secs / 86400).cast("long").alias("recency"),
        "frequency", "monetary")


def rfm_segments(tx: DataFrame, customer_col: str, date_col: str, amount_col: str,
                 analysis_date=None) -> DataFrame:
    """customer_id, recency, frequency, monetary, r_score, f_score, m_score,
    rfm_score, segment."""
    # The per-customer table is read by three independent rankings; write it
    # once so each ranking scans it instead of re-running the aggregation.
    m = reliable_checkpoint(rfm_metrics(tx, customer_col, date_col, amount_col, analysis_date))
    f = stats.qcut_ranked(m.select("customer_id", "frequency"), "frequency", "customer_id", out="f_score")
    mm = stats.qcut_ranked(m.select("customer_id", "monetary"), "monetary", "customer_id", out="m_score")
    r = stats.qcut_raw(m, "recency", "customer_id", out="_r_label")
    m = r.join(f.select("customer_id", "f_score"), "customer_id") \
         .join(mm.select("customer_id", "m_score"), "customer_id")
    m = m.withColumn("r_score", F.coalesce(F.lit(4) - F.col("_r_label"), F.lit(1)).cast("int")).drop("_r_label")
    code = F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    fallback = F.when(total > 9, "High Value").when(total > 6, "Medium Value").otherwise("Low Value")
    return m.withColumn("rfm_score", code.cast("int")) \
            .withColumn("segment", F.coalesce(segment_map_expr()[F.col("rfm_score")], fallback)) \
            .select("customer_id", "recency", "frequency", "monetary",
                    "r_score", "f_score", "m_score", "rfm_score", "segment")


def segment_metrics(rfm: DataFrame) -> DataFrame:
    """Per segment: customers, mean R/F/M, total value and share of the grand
    total (%).  The input has one row per customer, the output one per segment."""
    seg = rfm.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"),
        F.sum("monetary").alias("total_value"))
    return stats.share(seg, "total_value", out="value_pct")


def rfm_crosstab(rfm: DataFrame) -> DataFrame:
    """Mean M score by R score (rows) × F score (columns 1..4)."""
    return rfm.groupBy("r_score").pivot("f_score", [1, 2, 3, 4]).agg(F.avg("m_score")) \
              .select("r_score", *[F.col(str(i)).alias(f"f{i}_avg_m") for i in range(1, 5)])


def segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"),
                                      F.avg("monetary").alias("avg_monetary"))
