"""RFM analyses over ``orders`` (customer = o_custkey, date = o_orderdate,
amount = o_totalprice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import rfm
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")


def _segment_case(col: str = "rfm_score") -> str:
    whens = " ".join(
        f"WHEN {col} IN ({', '.join(str(c) for c in codes)}) THEN '{name.replace(chr(39), chr(39) * 2)}'"
        for name, codes in rfm.SEGMENT_CODES.items())
    return (f"CASE {whens} WHEN r_score + f_score + m_score > 9 THEN 'High Value' "
            f"WHEN r_score + f_score + m_score > 6 THEN 'Medium Value' ELSE 'Low Value' END")


_RFM_CTE = f"""
WITH per AS (
  SELECT o_custkey AS customer_id, max(o_orderdate) AS last_purchase,
         count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey),
ad AS (SELECT max(last_purchase) + INTERVAL 1 DAY AS ad FROM per),
m AS (SELECT customer_id,
             CAST(floor((epoch(ad) - epoch(last_purchase)) / 86400) AS BIGINT) AS recency,
             frequency, monetary FROM per, ad),
e AS (SELECT list_distinct(quantile_cont(recency, [0, 0.25, 0.5, 0.75, 1.0])) AS edges,
             count(*) AS n FROM m),
r AS (SELECT m.*, n,
             CASE WHEN len(edges) < 2 THEN NULL
                  ELSE greatest(0, len(list_filter(edges, lambda x: x < recency)) - 1) END AS rl,
             row_number() OVER (ORDER BY frequency, customer_id) AS fr,
             row_number() OVER (ORDER BY monetary, customer_id) AS mr
      FROM m, e),
s AS (SELECT customer_id, recency, frequency, monetary,
             CAST(coalesce(4 - rl, 1) AS INTEGER) AS r_score,
             CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, floor((4 * (fr - 1) + n - 2) / (n - 1))) END AS INTEGER) AS f_score,
             CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, floor((4 * (mr - 1) + n - 2) / (n - 1))) END AS INTEGER) AS m_score
      FROM r),
seg AS (SELECT *, CAST(r_score * 100 + f_score * 10 + m_score AS INTEGER) AS rfm_score FROM s),
rfm AS (SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score, rfm_score,
               {_segment_case()} AS segment FROM seg)
"""


def rfm_table(spark, d):
    return rfm.rfm_segments(_orders(spark, d), "o_custkey", "o_orderdate", "o_totalprice")


@register("rfm_segments", sql=_RFM_CTE + "SELECT * FROM rfm", headline=True)
def q_rfm_segments(spark, d):
    return rfm_table(spark, d)


@register("rfm_metrics", sql="""
SELECT o_custkey AS customer_id,
       CAST(floor((epoch((SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY) - epoch(max(o_orderdate))) / 86400) AS BIGINT) AS recency,
       count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary
FROM orders GROUP BY o_custkey""")
def q_rfm_metrics(spark, d):
    return rfm.rfm_metrics(_orders(spark, d), "o_custkey", "o_orderdate", "o_totalprice")


@register("segment_metrics", sql=_RFM_CTE + """,
agg AS (SELECT segment, count(*) AS customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
               avg(monetary) AS avg_monetary, sum(monetary) AS total_value FROM rfm GROUP BY segment)
SELECT segment, customers, round(avg_recency, 4) AS avg_recency, round(avg_frequency, 4) AS avg_frequency,
       round(avg_monetary, 2) AS avg_monetary, round(total_value, 2) AS total_value,
       round(total_value / sum(total_value) OVER () * 100, 4) AS value_pct
FROM agg""")
def q_segment_metrics(spark, d):
    s = rfm.segment_metrics(rfm_table(spark, d))
    return s.select("segment", "customers", F.round("avg_recency", 4).alias("avg_recency"),
                    F.round("avg_frequency", 4).alias("avg_frequency"),
                    F.round("avg_monetary", 2).alias("avg_monetary"),
                    F.round("total_value", 2).alias("total_value"),
                    F.round("value_pct", 4).alias("value_pct"))


@register("rfm_crosstab", sql=_RFM_CTE + """
SELECT r_score,
       round(avg(CASE WHEN f_score = 1 THEN m_score END), 6) AS f1_avg_m,
       round(avg(CASE WHEN f_score = 2 THEN m_score END), 6) AS f2_avg_m,
       round(avg(CASE WHEN f_score = 3 THEN m_score END), 6) AS f3_avg_m,
       round(avg(CASE WHEN f_score = 4 THEN m_score END), 6) AS f4_avg_m
FROM rfm GROUP BY r_score""")
def q_rfm_crosstab(spark, d):
    x = rfm.rfm_crosstab(rfm_table(spark, d))
    return x.select("r_score", *[F.round(f"f{i}_avg_m", 6).alias(f"f{i}_avg_m") for i in range(1, 5)])


@register("segment_counts", sql=_RFM_CTE + """
SELECT segment, count(*) AS customers, round(avg(monetary), 2) AS avg_monetary FROM rfm GROUP BY segment""")
def q_segment_counts(spark, d):
    return rfm.segment_counts(rfm_table(spark, d)).withColumn("avg_monetary", F.round("avg_monetary", 2))
