"""Single-operator views: each inventory item that otherwise only appears
inside a composed analysis gets its own named query over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import text as T
from ledgerline.operators import clean, inventory as inv, knn, profile, rfm, ridge
from ledgerline.operators import text as TX
from ledgerline.plans import q_pricing, q_rfm, q_supply, q_text
from ledgerline.plans.q_general import _GAPPY, _gappy_lineitem
from ledgerline.plans.q_inventory import _ITEMS, items
from ledgerline.plans.registry import register
from ledgerline.session import reliable_checkpoint
from ledgerline.sources.tables import table

# ------------------------------------------------------------------ RFM pieces


@register("qcut_raw", sql=q_rfm._RFM_CTE + "SELECT customer_id, recency, r_score FROM rfm")
def q_qcut_raw(spark, d):
    return q_rfm.rfm_table(spark, d).select("customer_id", "recency", "r_score")


@register("qcut_ranked", sql=q_rfm._RFM_CTE + "SELECT customer_id, frequency, f_score, monetary, m_score FROM rfm")
def q_qcut_ranked(spark, d):
    return q_rfm.rfm_table(spark, d).select("customer_id", "frequency", "f_score", "monetary", "m_score")


@register("rfm_score", sql=q_rfm._RFM_CTE + "SELECT customer_id, rfm_score FROM rfm")
def q_rfm_score(spark, d):
    return q_rfm.rfm_table(spark, d).select("customer_id", S.rfm_score("r_score", "f_score", "m_score").cast("int").alias("rfm_score"))


@register("lookup_segment", sql=q_rfm._RFM_CTE + "SELECT DISTINCT rfm_score, segment FROM rfm")
def q_lookup_segment(spark, d):
    return q_rfm.rfm_table(spark, d).select("rfm_score", "segment").distinct()


# Fixed values (our own wording): recommended action per segment group.
SEGMENT_ACTIONS = {
    "Champions": "reward and ask for referrals",
    "Loyal Customers": "offer loyalty upgrades",
    "Potential Loyalists": "recommend related products",
    "Recent Customers": "onboard and follow up",
    "Promising": "send introductory offers",
    "Need Attention": "send limited-time offers",
    "About to Sleep": "reconnect with personalised content",
    "At Risk": "win back with service outreach",
    "Can't Lose Them": "make a direct retention offer",
    "Hibernating": "offer a low-cost reactivation deal",
    "Lost": "run a last reactivation campaign",
    "High Value": "keep engaged with premium offers",
    "Medium Value": "grow basket size",
    "Low Value": "nurture at low cost",
}


def _actions_case():
    return "CASE segment " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'"
                                      for k, v in SEGMENT_ACTIONS.items()) + " END"


@register("segment_plan", sql=q_rfm._RFM_CTE + f"""
SELECT segment, count(*) AS customers, round(sum(monetary) / sum(sum(monetary)) OVER () * 100, 4) AS value_pct,
       {_actions_case()} AS action FROM rfm GROUP BY segment""")
def q_segment_plan(spark, d):
    seg = rfm.segment_metrics(q_rfm.rfm_table(spark, d))
    return seg.select("segment", "customers", F.round("value_pct", 4).alias("value_pct"),
                      S.literal_map(SEGMENT_ACTIONS)[F.col("segment")].alias("action"))


# ------------------------------------------------------------------ rule functions as queries

_PROB = "(SELECT doc_id, n_chars / (SELECT max(n_chars) FROM documents) AS p FROM documents)"


def _prob(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    mx = doc.agg(F.max("n_chars").alias("_mx"))
    return doc.crossJoin(mx).select("doc_id", (F.col("n_chars") / F.col("_mx")).alias("p"))


@register("risk_level", sql=f"""
SELECT doc_id, CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level,
       CAST(p >= 0.5 AS INTEGER) AS predicted FROM {_PROB}""")
def q_risk_level(spark, d):
    p = _prob(spark, d)
    return p.select("doc_id", S.risk_level("p").alias("risk_level"), (F.col("p") >= 0.5).cast("int").alias("predicted"))


def _sent(spark, d):
    return q_text.scored(spark, d)


@register("sentiment_label", sql=q_text._SENT_CTE + "SELECT doc_id, sentiment_label FROM lab")
def q_sentiment_label(spark, d):
    return _sent(spark, d).select("doc_id", "sentiment_label")


@register("sentiment_confidence", sql=q_text._SENT_CTE + "SELECT doc_id, round(confidence, 6) AS confidence FROM lab")
def q_sentiment_confidence(spark, d):
    return _sent(spark, d).select("doc_id", F.round("confidence", 6).alias("confidence"))


@register("emotion_scores", sql=q_text._SENT_CTE + """
SELECT doc_id, round(joy, 5) AS joy, round(sadness, 5) AS sadness, round(anger, 5) AS anger,
       round(fear, 5) AS fear, round(surprise, 5) AS surprise FROM emo""")
def q_emotion_scores(spark, d):
    return _sent(spark, d).select("doc_id", *[F.round(c, 5).alias(c) for c in ("joy", "sadness", "anger", "fear", "surprise")])


@register("mixed_sentiment", sql=q_text._SENT_CTE + """
SELECT doc_id, pos > 0.2 AND neg > 0.2 AS mixed, round(abs(compound), 6) AS intensity FROM sc""")
def q_mixed(spark, d):
    return _sent(spark, d).select("doc_id", "mixed", F.round("intensity", 6).alias("intensity"))


@register("sentiment_polarity", sql=q_text._SENT_CTE + """
SELECT doc_id, round(CASE WHEN polarity > 0 THEN (polarity + 1) / 2 ELSE 0.0 END, 6) AS pos,
       round(CASE WHEN polarity < 0 THEN (1 - polarity) / 2 ELSE 0.0 END, 6) AS neg,
       round(CASE WHEN polarity > 0 THEN 1 - (polarity + 1) / 2 WHEN polarity < 0 THEN 1 - (1 - polarity) / 2 ELSE 1.0 END, 6) AS neu,
       round(polarity, 6) AS compound FROM sc""")
def q_sentiment_polarity(spark, d):
    s = TX.sentiment_scores(q_text.profiles(spark, d), "text")
    p = TX.polarity_scores("polarity")
    return s.select("doc_id", *[F.round(p[k], 6).alias(k) for k in ("pos", "neg", "neu", "compound")])


@register("sentiment_ensemble", sql=q_text._SENT_CTE + """
SELECT doc_id, round(0.625 * compound + 0.375 * polarity, 6) AS ensemble_compound FROM sc""")
def q_sentiment_ensemble(spark, d):
    return _sent(spark, d).select("doc_id", F.round("ensemble_compound", 6).alias("ensemble_compound"))


@register("sentiment_compare", sql=q_text._SENT_CTE + """
SELECT doc_id, 'lexicon' AS model, round(compound, 6) AS compound FROM sc
UNION ALL SELECT doc_id, 'polarity', round(polarity, 6) FROM sc
UNION ALL SELECT doc_id, 'ensemble', round(0.625 * compound + 0.375 * polarity, 6) FROM sc""")
def q_sentiment_compare(spark, d):
    s = _sent(spark, d).select("doc_id", F.col("compound").alias("lexicon"), F.col("polarity"),
                               F.col("ensemble_compound").alias("ensemble"))
    u = s.unpivot("doc_id", ["lexicon", "polarity", "ensemble"], "model", "compound")
    return u.withColumn("compound", F.round("compound", 6))


@register("join_daily_sentiment", sql=q_text._SENT_CTE + """,
daily AS (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date, avg(compound) AS m FROM lab GROUP BY 1),
counts AS (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date, count(*) AS texts FROM lab GROUP BY 1)
SELECT daily.date, round(m, 6) AS avg_compound, texts FROM daily JOIN counts ON daily.date = counts.date""")
def q_join_daily(spark, d):
    s = _sent(spark, d).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")))
    daily = s.groupBy("date").agg(F.round(F.avg("compound"), 6).alias("avg_compound"))
    counts = s.groupBy("date").agg(F.count(F.lit(1)).alias("texts"))
    return daily.join(counts, "date")


@register("season_weather", sql="""
SELECT event_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 4 WHEN month(ts) IN (3, 4, 5) THEN 2 WHEN month(ts) IN (6, 7, 8) THEN 1 ELSE 3 END AS weather_code FROM events""")
def q_season_weather(spark, d):
    return table(spark, d, "events").select("event_id", S.season_weather("ts").alias("weather_code"))


@register("holiday_flag", sql=f"""
SELECT o_orderkey, isodow(o_orderdate) >= 6 OR strftime(o_orderdate, '%Y-%m-%d') IN ({', '.join(repr(h) for h in S.US_HOLIDAYS)}) AS is_holiday FROM orders""")
def q_holiday_flag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.is_holiday("o_orderdate").alias("is_holiday"))


@register("lookup_factors", sql=f"""
SELECT shipment_id,
       CAST(CASE weather WHEN 'normal' THEN 1.0 WHEN 'rain' THEN 1.3 WHEN 'snow' THEN 1.8 WHEN 'storm' THEN 2.5 WHEN 'fog' THEN 1.4 ELSE 1.0 END AS DOUBLE) AS weather_factor,
       CAST(CASE traffic WHEN 'light' THEN 0.9 WHEN 'normal' THEN 1.0 WHEN 'heavy' THEN 1.5 WHEN 'congested' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS traffic_factor,
       CAST(CASE vehicle_type WHEN 'truck' THEN 1.2 WHEN 'van' THEN 1.0 WHEN 'motorcycle' THEN 0.8 WHEN 'drone' THEN 0.6 ELSE 1.0 END AS DOUBLE) AS vehicle_factor
FROM {q_supply._SHIP}""")
def q_lookup_factors(spark, d):
    s = q_supply.shipments(spark, d)
    return s.select("shipment_id", S.factor(S.WEATHER_FACTORS, "weather").alias("weather_factor"),
                    S.factor(S.TRAFFIC_FACTORS, "traffic").alias("traffic_factor"),
                    S.factor(S.VEHICLE_FACTORS, "vehicle_type").alias("vehicle_factor"))


@register("lookup_group_value", sql=q_pricing._PRODUCTS_CTE + """
SELECT product_id, category, round(elasticity, 4) AS elasticity FROM products""")
def q_lookup_group_value(spark, d):
    return q_pricing.products(spark, d).select("product_id", "category", F.round("elasticity", 4).alias("elasticity"))


@register("sort_by_metric", sql=q_supply._PRED_CTE + """
SELECT shipment_id, round(delay_hours, 4) AS delay_hours FROM pred""")
def q_sort_by_metric(spark, d):
    p = q_supply.predictions(spark, d).select("shipment_id", F.round("delay_hours", 4).alias("delay_hours"))
    return p.orderBy(F.desc("delay_hours"), "shipment_id")


@register("sort_multi", sql=f"""
SELECT shipment_id, priority, expected_delivery FROM {q_supply._SHIP}""")
def q_sort_multi(spark, d):
    s = q_supply.shipments(spark, d).select("shipment_id", "priority", "expected_delivery")
    return s.orderBy("priority", "expected_delivery", "shipment_id")


@register("supply_analytics", sql=q_supply._PRED_CTE + """
SELECT tenant, count(*) AS shipments, round(sum(distance_km), 2) AS total_distance_km,
       round(sum(distance_km * cost_per_km), 2) AS total_cost,
       round(CASE WHEN sum(distance_km) = 0 THEN 0.0 ELSE sum(distance_km * cost_per_km) / sum(distance_km) END, 6) AS cost_per_km,
       count(*) FILTER (WHERE delay_hours > 4) AS delays_over_4h, round(avg(confidence), 6) AS avg_confidence FROM pred GROUP BY tenant""")
def q_supply_analytics(spark, d):
    p = q_supply.predictions(spark, d)
    a = p.groupBy("tenant").agg(F.count(F.lit(1)).alias("shipments"), F.sum("distance_km").alias("_km"),
                                F.sum(F.col("distance_km") * F.col("cost_per_km")).alias("_cost"),
                                F.count_if(F.col("delay_hours") > 4).alias("delays_over_4h"),
                                F.avg("confidence").alias("_conf"))
    return a.select("tenant", "shipments", F.round("_km", 2).alias("total_distance_km"), F.round("_cost", 2).alias("total_cost"),
                    F.round(F.coalesce(F.try_divide("_cost", "_km"), F.lit(0.0)), 6).alias("cost_per_km"),
                    "delays_over_4h", F.round("_conf", 6).alias("avg_confidence"))


# ------------------------------------------------------------------ cleaning pieces

@register("drop_key_nulls", sql=f"SELECT l_orderkey, l_linenumber, q FROM {_GAPPY} WHERE q IS NOT NULL")
def q_drop_key_nulls(spark, d):
    return clean.drop_key_nulls(_gappy_lineitem(spark, d), ["q"]).select("l_orderkey", "l_linenumber", "q")


@register("clean_numeric", sql="""
SELECT o_orderkey, coalesce(TRY_CAST(raw AS DOUBLE), 0.0) AS amount
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS raw FROM orders)""")
def q_clean_numeric(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", S.clean_numeric(raw).alias("amount"))


@register("impute_knn_single", sql=f"""
SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM {_GAPPY})), 6) AS q FROM {_GAPPY}""")
def q_impute_knn_single(spark, d):
    g = _gappy_lineitem(spark, d)
    # a row without its only feature has no neighbours: the nearest rows are all rows
    x = clean.impute(g, "q", "_id", "mean")
    return x.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


KNN_COLS = ["size", "price", "n_lines", "max_line"]
_KNN_PARTS = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS x0,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS x1,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE n::DOUBLE END AS x2, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE m END AS x3
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""


def knn_parts(spark, d):
    """Parts with gaps in four numeric columns."""
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("l_extendedprice").alias("m"))
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    gap = lambda n, c: F.when(F.col("p_partkey") % n != 0, c)
    return p.join(li, p.p_partkey == li.l_partkey, "left").select(
        F.col("p_partkey").alias("id"), gap(5, F.col("p_size").cast("double")).alias("size"), gap(7, F.col("p_retailprice")).alias("price"),
        gap(11, F.col("n")).alias("n_lines"), gap(13, F.col("m")).alias("max_line"))


@register("impute_knn", sql=f"""
WITH p AS MATERIALIZED ({_KNN_PARTS}),
pairs AS (
  SELECT r.id, d.id AS donor, d.x0 AS d0, d.x1 AS d1, d.x2 AS d2, d.x3 AS d3, r.x0 AS r0, r.x1 AS r1, r.x2 AS r2, r.x3 AS r3,
         (coalesce((r.x0 - d.x0) * (r.x0 - d.x0), 0) + coalesce((r.x1 - d.x1) * (r.x1 - d.x1), 0) + coalesce((r.x2 - d.x2) * (r.x2 - d.x2), 0)
          + coalesce((r.x3 - d.x3) * (r.x3 - d.x3), 0)) * 4
         / nullif((r.x0 - d.x0 IS NOT NULL)::INT + (r.x1 - d.x1 IS NOT NULL)::INT + (r.x2 - d.x2 IS NOT NULL)::INT + (r.x3 - d.x3 IS NOT NULL)::INT, 0) AS dist
  FROM p r JOIN p d ON r.x0 IS NULL OR r.x1 IS NULL OR r.x2 IS NULL OR r.x3 IS NULL),
t AS ({" UNION ALL ".join(f"SELECT id, {i} AS target, dist, donor, d{i} AS v FROM pairs WHERE r{i} IS NULL AND d{i} IS NOT NULL AND dist IS NOT NULL" for i in range(4))}),
f AS (SELECT id, target, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id, target ORDER BY dist, donor) AS r FROM t) WHERE r <= 5 GROUP BY ALL)
SELECT p.id, {", ".join(f"round(coalesce(x{i}, (SELECT v FROM f WHERE f.id = p.id AND target = {i}), (SELECT avg(x{i}) FROM p)), 6) AS {c}" for i, c in enumerate(KNN_COLS))}
FROM p""")
def q_impute_knn(spark, d):
    """Gaps of four columns from the five nearest parts."""
    x = knn.impute_knn(knn_parts(spark, d), KNN_COLS, "id", 5)
    return x.select("id", *[F.round(c, 6).alias(c) for c in KNN_COLS])


@register("impute_auto", sql=f"""
WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q,
                  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM g)), 6) AS q,
       coalesce(flag, (SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM g""")
def q_impute_auto(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("q"),
                  F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("flag")) \
        .withColumn("_id", F.struct("l_orderkey", "l_linenumber"))
    x = clean.impute(clean.impute(g, "q", "_id", "mean"), "flag", "_id", "mode")
    return x.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"), "flag")


@register("align_features", sql="""
SELECT c_custkey, c_acctbal, CAST(0.0 AS DOUBLE) AS n_orders, 'unknown' AS c_mktsegment FROM customer""")
def q_align_features(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return clean.align_features(c, {"c_custkey": None, "c_acctbal": 0.0, "n_orders": 0.0, "c_mktsegment": "unknown"})


@register("union_append", sql="""
SELECT c_name AS name, c_nationkey AS nationkey FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier""")
def q_union_append(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return clean.union_append(c, s)


# ------------------------------------------------------------------ row maintenance on inventory items

@register("insert_rows", sql=f"""
SELECT id, name FROM {_ITEMS} UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier""")
def q_insert_rows(spark, d):
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000000).alias("id"), F.col("s_name").alias("name"))
    return inv.insert_rows(items(spark, d).select("id", "name"), new)


@register("patch_rows", sql=f"""
SELECT i.id, coalesce(p.quantity, i.quantity) AS quantity,
       CASE WHEN p.quantity IS NOT NULL THEN '2024-01-01' ELSE CAST(i.updated_at AS VARCHAR) END AS updated_at
FROM {_ITEMS} i LEFT JOIN (SELECT p_partkey AS id, CAST(p_size * 100 AS BIGINT) AS quantity FROM part WHERE p_size > 45) p ON p.id = i.id""")
def q_patch_rows(spark, d):
    base = items(spark, d).select("id", "quantity", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    patch = table(spark, d, "part").filter(F.col("p_size") > 45) \
        .select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100).cast("long").alias("quantity"))
    return inv.patch_rows(base, patch, "id", "updated_at", "2024-01-01")


@register("delete_rows", sql=f"""
SELECT id, name FROM {_ITEMS} WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def q_delete_rows(spark, d):
    ids = table(spark, d, "part").filter(F.col("p_type") == "ECONOMY").select(F.col("p_partkey").alias("id"))
    return inv.delete_rows(items(spark, d).select("id", "name"), ids, "id")


# ------------------------------------------------------------------ profiling rules

@register("detect_target_binary", sql="""
WITH c AS (SELECT 'doc_id' AS col, 0 AS pos, count(DISTINCT doc_id) AS d, 'labels' AS src FROM labels
           UNION ALL SELECT 'quality', 1, count(DISTINCT quality), 'labels' FROM labels
           UNION ALL SELECT 'toxic', 2, count(DISTINCT toxic), 'labels' FROM labels
           UNION ALL SELECT 'o_orderkey', 0, count(DISTINCT o_orderkey), 'orders' FROM orders
           UNION ALL SELECT 'o_custkey', 1, count(DISTINCT o_custkey), 'orders' FROM orders
           UNION ALL SELECT 'o_orderstatus', 2, count(DISTINCT o_orderstatus), 'orders' FROM orders
           UNION ALL SELECT 'o_totalprice', 3, count(DISTINCT o_totalprice), 'orders' FROM orders),
r AS (SELECT *, CASE WHEN contains(col, 'status') THEN 0 WHEN d = 2 THEN 1 END AS rank FROM c)
SELECT 'keyword' AS rule, (SELECT arg_min(col, rank * 100 + pos) FROM r WHERE src = 'orders' AND rank IS NOT NULL) AS target
UNION ALL SELECT 'two values', (SELECT arg_min(col, rank * 100 + pos) FROM r WHERE src = 'labels' AND rank IS NOT NULL)
UNION ALL SELECT 'suggested', (SELECT CASE WHEN d = 2 THEN col END FROM r WHERE col = 'toxic')""")
def q_detect_target_binary(spark, d):
    labels = reliable_checkpoint(profile.profile_columns(table(spark, d, "labels")))
    orders = profile.profile_columns(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    found = [("keyword", profile.detect_target_binary(orders)), ("two values", profile.detect_target_binary(labels)),
             ("suggested", profile.detect_target_binary(labels, suggested=("doc_id", "toxic")))]
    rows = [df.select(F.lit(rule).alias("rule"), "target") for rule, df in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("detect_date_column", sql="SELECT 'l_shipdate' AS date_column, count(*) AS rows FROM lineitem")
def q_detect_date_column(spark, d):
    li = table(spark, d, "lineitem")
    p = profile.profile_columns(li)
    first = p.filter(F.col("data_type") == "datetime").agg(F.min_by("column", "position").alias("date_column"))
    return first.crossJoin(li.agg(F.count(F.lit(1)).alias("rows")))


_LI_TYPES = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
             ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime")]


def _trend_type_sql():
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count(*) AS rows, count(DISTINCT {c}) AS d FROM lineitem"
             for c, t in _LI_TYPES]
    return " UNION ALL ".join(parts)


@register("profile_trend_types", sql=f"""
SELECT "column", CASE WHEN data_type = 'datetime' THEN 'datetime'
                      WHEN data_type IN ('integer', 'float') AND d <= least(30, rows // 10) THEN 'categorical'
                      WHEN data_type IN ('integer', 'float') THEN 'numeric'
                      WHEN d <= least(30, rows // 10) THEN 'categorical' ELSE 'text' END AS kind,
       data_type IN ('integer', 'float') AND (d > 10 OR d > 0.05 * rows) AS target_candidate
FROM ({_trend_type_sql()})""")
def q_profile_trend_types(spark, d):
    p = profile.profile_columns(table(spark, d, "lineitem"))
    num = F.col("data_type").isin("integer", "float")
    small = F.col("distinct_count") <= F.least(F.lit(30), F.floor(F.col("rows") / 10))
    kind = F.when(F.col("data_type") == "datetime", "datetime").when(num & small, "categorical").when(num, "numeric") \
            .when(small, "categorical").otherwise("text")
    tc = num & ((F.col("distinct_count") > 10) | (F.col("distinct_count") > 0.05 * F.col("rows")))
    return p.select("column", kind.alias("kind"), tc.alias("target_candidate"))


# ------------------------------------------------------------------ text pieces

@register("required_vs_found", sql=f"""
SELECT doc_id, array_to_string(list_filter(['SQL', 'AWS', 'AI', 'Git'], lambda x: list_contains(f, x)), ',') AS matched,
       array_to_string(list_filter(['SQL', 'AWS', 'AI', 'Git'], lambda x: NOT list_contains(f, x)), ',') AS missing
FROM (SELECT doc_id, string_split({q_text._skills_sql()}, ',') AS f FROM {q_text.PROFILES})""")
def q_required_vs_found(spark, d):
    req = F.array(*[F.lit(s) for s in ["SQL", "AWS", "AI", "Git"]])
    found = T.extract_skills(F.col("text"))
    return q_text.profiles(spark, d).select(
        "doc_id", F.array_join(F.array_intersect(req, found), ",").alias("matched"),
        F.array_join(F.array_except(req, found), ",").alias("missing"))


@register("skills_from_job", sql=f"""
SELECT item_id, {q_text._skills_sql().replace('text', 'b.text')} AS skills FROM {q_text._phrased_sql('item_id', 'benchmark')} b""")
def q_skills_from_job(spark, d):
    b = table(spark, d, "benchmark").select("item_id", q_text.phrased("item_id").alias("text"))
    return b.select("item_id", F.array_join(T.extract_skills(F.col("text")), ",").alias("skills"))


@register("clean_cells", sql="""
SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS n_cells
FROM conversations""")
def q_clean_cells(spark, d):
    from ledgerline.operators import layout
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(layout.clean_cells(F.split("text", "\n"))).alias("n_cells"))


# ------------------------------------------------------------------ model routing

# daily demand of every product: quantity by mean unit price and month; the ridge models by their normal equations
_PRODUCT_DAYS = """
SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice * (1 - l_discount) / l_quantity) AS x,
       month(CAST(l_shipdate AS DATE))::DOUBLE AS z, sum(l_quantity)::DOUBLE AS y, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) % 5 AS f
FROM lineitem GROUP BY ALL"""
_SUMS = {"n": "1.0", "sx": "x", "sz": "z", "sy": "y", "sxx": "x * x", "sxz": "x * z", "szz": "z * z", "sxy": "x * y", "szy": "z * y", "syy": "y * y"}
_RIDGES = f"""
g AS MATERIALIZED ({_PRODUCT_DAYS}),
s AS MATERIALIZED (SELECT k, f, {", ".join(f"sum({e}) AS {c}" for c, e in _SUMS.items())} FROM g GROUP BY k, f),
t AS MATERIALIZED (SELECT k, -1 AS f, {", ".join(f"sum({c}) AS {c}" for c in _SUMS)} FROM s GROUP BY k HAVING sum(n) >= 10),
fits AS (SELECT * FROM t UNION ALL SELECT s.k, s.f, {", ".join(f"t.{c} - s.{c}" for c in _SUMS)} FROM s JOIN t USING (k) WHERE t.n - s.n >= 1),
c AS (SELECT *, sxx - sx * sx / n AS cxx, sxz - sx * sz / n AS cxz, szz - sz * sz / n AS czz, sxy - sx * sy / n AS cxy, szy - sz * sy / n AS czy FROM fits),
d AS (SELECT *, CASE WHEN cxx / n <= 1e-12 * (1 + sx * sx / n / n) THEN 1 ELSE sqrt(cxx / n) END AS ax,
             CASE WHEN czz / n <= 1e-12 * (1 + sz * sz / n / n) THEN 1 ELSE sqrt(czz / n) END AS az FROM c),
e AS (SELECT *, cxx / ax / ax + 1 AS a11, czz / az / az + 1 AS a22, cxz / ax / az AS a12, cxy / ax AS b1, czy / az AS b2 FROM d),
w AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) / ax AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) / az AS w2 FROM e),
m AS MATERIALIZED (SELECT k, f, w1, w2, (sy - w1 * sx - w2 * sz) / n AS w0 FROM w),
err AS MATERIALIZED (
  SELECT m.k, m.f, o.n, o.sy, o.syy, greatest(syy + w0 * w0 * n + w1 * w1 * sxx + w2 * w2 * szz + 2 * w0 * w1 * sx + 2 * w0 * w2 * sz + 2 * w1 * w2 * sxz
         - 2 * w0 * sy - 2 * w1 * sxy - 2 * w2 * szy, 0) AS sse FROM m JOIN (SELECT * FROM s UNION ALL SELECT * FROM t) o ON o.k = m.k AND o.f = m.f)"""


def product_days(spark, d):
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_partkey", F.to_date("l_shipdate").alias("date")).agg(
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("price"), F.sum("l_quantity").cast("double").alias("label"))
    return g.withColumn("month", F.month("date").cast("double"))


def product_models(days):
    return ridge.fit_per_key(days, "l_partkey", ["price", "month"], "label", F.datediff("date", F.lit("1970-01-01")))


@register("demand_products", sql=f"""
WITH {_RIDGES}
SELECT m.k AS l_partkey, e.n::BIGINT AS n, round(w0, 4) AS intercept, round(w1, 6) AS price_coef, round(w2, 4) AS month_coef, round(sqrt(sse / e.n), 4) AS rmse,
       round(CASE WHEN syy - sy * sy / e.n > 1e-9 * (1 + syy) THEN 1 - sse / (syy - sy * sy / e.n) END, 4) AS r2,
       round((SELECT avg(sqrt(v.sse / v.n)) FROM err v WHERE v.k = m.k AND v.f >= 0), 4) AS cv_rmse
FROM m JOIN err e ON e.k = m.k AND e.f = -1 WHERE m.f = -1""")
def q_demand_products(spark, d):
    """A demand model for every product of ten days or more, with the error of a 5-fold cross-validation."""
    models = product_models(product_days(spark, d))
    return models.select("l_partkey", "n", F.round("intercept", 4).alias("intercept"), F.round(F.get("coefs", F.lit(0)), 6).alias("price_coef"),
                         F.round(F.get("coefs", F.lit(1)), 4).alias("month_coef"), *[F.round(c, 4).alias(c) for c in ("rmse", "r2", "cv_rmse")])


@register("route_to_model", sql=f"""
WITH {_RIDGES}
SELECT g.k AS l_partkey, g.date, round(w0 + w1 * x + w2 * z, 4) AS prediction, CASE WHEN m.k IS NULL THEN 'no model' END AS error
FROM g LEFT JOIN m ON m.k = g.k AND m.f = -1""")
def q_route_to_model(spark, d):
    """Every product day scored by its product's model; days of products without one come back with an error."""
    days = reliable_checkpoint(product_days(spark, d))
    scored, failed = ridge.score_per_key(days, product_models(days), "l_partkey", ["price", "month"])
    return scored.select("l_partkey", "date", F.round("prediction", 4).alias("prediction"), F.lit(None).cast("string").alias("error")) \
        .unionByName(failed.select("l_partkey", "date", F.lit(None).cast("double").alias("prediction"), "error"))


# ------------------------------------------------------------------ feature selection (ANOVA F)

# ten counts over the text: name -> (Spark pattern of the counted characters, the same in SQL)
_KB_CHARS = {"letters": r"\p{L}", "digits": "[0-9]", "upper": r"\p{Lu}", "blanks": "[ ]", "lines": "[\\n]", "commas": "[,]",
             "stops": "[.]", "marks": "[!?]", "symbols": "[#*$%&|<>]"}
_KB = 5


@register("select_kbest", sql=f"""
WITH f AS (SELECT quality AS y, UNNEST([{{'feature': 'n_chars', 'v': CAST(n_chars AS DOUBLE)}}, {', '.join(
    f"{{'feature': '{k}', 'v': CAST(length(text) - length(regexp_replace(text, '{p}', '', 'g')) AS DOUBLE)}}" for k, p in _KB_CHARS.items())}]) AS r
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
x AS (SELECT y, r.feature AS feature, r.v AS v FROM f),
g AS (SELECT feature, y, count(*) AS n, avg(v) AS m FROM x GROUP BY feature, y),
t AS (SELECT feature, avg(v) AS gm, count(*) AS n FROM x GROUP BY feature),
b AS (SELECT g.feature, sum(g.n * (g.m - t.gm) * (g.m - t.gm)) AS ssb, count(*) AS k FROM g JOIN t USING (feature) GROUP BY g.feature),
w AS (SELECT x.feature, sum((x.v - g.m) * (x.v - g.m)) AS ssw FROM x JOIN g USING (feature, y) GROUP BY x.feature)
SELECT feature, round((ssb / (k - 1)) / (ssw / (t.n - k)), 6) AS f_stat FROM b JOIN w USING (feature) JOIN t USING (feature)
WHERE ssw > 0 ORDER BY (ssb / (k - 1)) / (ssw / (t.n - k)) DESC, feature LIMIT {_KB}""")
def q_select_kbest(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    counts = [F.struct(F.lit("n_chars").alias("feature"), F.col("n_chars").cast("double").alias("v"))]
    counts += [F.struct(F.lit(k).alias("feature"),
                        (F.length("text") - F.length(F.regexp_replace("text", p, ""))).cast("double").alias("v"))
               for k, p in _KB_CHARS.items()]
    long = x.select(F.col("quality").alias("y"), F.explode(F.array(*counts)).alias("r")).select("y", "r.feature", "r.v")
    return anova_f(long).orderBy(F.desc("f_stat"), "feature").limit(_KB).withColumn("f_stat", F.round("f_stat", 6))


def anova_f(long):
    """One-way ANOVA F of ``v`` across the classes ``y`` of every ``feature``
    (rows feature, y, v): one aggregation of counts, means and variances."""
    g = long.groupBy("feature", "y").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    t = g.groupBy("feature").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("s2")).alias("ssw"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.collect_list(F.struct("n", "m")).alias("parts"))
    ssb = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["n"] * (x["m"] - F.col("gm")) * (x["m"] - F.col("gm")))
    f = (ssb / (F.col("k") - 1)) / (F.col("ssw") / (F.col("total") - F.col("k")))
    return t.filter(F.col("ssw") > 0).select("feature", f.alias("f_stat"))

