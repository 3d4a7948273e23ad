"""Inventory analyses.  Item = part (category p_type, unit price
p_retailprice, minimum level p_size); quantity on hand = total lineitem
quantity; supplier = name of the lowest supplier key seen for the part;
updated_at = latest ship date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import inventory as inv
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table

BUDGET = 250000.0
AS_OF = "2024-01-01"


def items(spark, d):
    part = table(spark, d, "part")
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("quantity"), F.min("l_suppkey").alias("suppkey"),
        F.max("l_shipdate").alias("updated_at"))
    sup = table(spark, d, "supplier").select("s_suppkey", "s_name")
    j = part.join(li, part.p_partkey == li.l_partkey, "left") \
            .join(sup, F.col("suppkey") == sup.s_suppkey, "left")
    return j.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                    F.col("p_type").alias("category"), F.coalesce("quantity", F.lit(0)).alias("quantity"),
                    F.col("p_retailprice").alias("unit_price"), F.col("s_name").alias("supplier"),
                    F.col("p_size").alias("min_stock_level"), "updated_at")


_ITEMS = """(SELECT p_partkey AS id, p_name AS name, p_type AS category, coalesce(CAST(li.quantity AS BIGINT), 0) AS quantity,
        p_retailprice AS unit_price, s_name AS supplier, p_size AS min_stock_level, li.updated_at
 FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS quantity, min(l_suppkey) AS suppkey, max(l_shipdate) AS updated_at
                      FROM lineitem GROUP BY l_partkey) li ON li.l_partkey = p_partkey
      LEFT JOIN supplier ON s_suppkey = li.suppkey)"""


@register("inventory_overview", sql=f"""
SELECT category, count(*) AS items, round(sum(quantity * unit_price), 2) AS value FROM {_ITEMS} GROUP BY category""")
def q_inventory_overview(spark, d):
    return inv.overview_by_category(items(spark, d)).withColumn("value", F.round("value", 2))


@register("inventory_totals", sql=f"""
SELECT count(*) AS total_items, round(sum(quantity * unit_price), 2) AS total_value, count(DISTINCT category) AS categories
FROM {_ITEMS}""")
def q_inventory_totals(spark, d):
    return inv.overview_totals(items(spark, d)).withColumn("total_value", F.round("total_value", 2))


# the low-stock rule compares against ten times the minimum level so the
# whole-table check has hits at every scale
@register("low_stock", sql=f"""
SELECT id, name, category, quantity, min_stock_level FROM
  (SELECT id, name, category, quantity, min_stock_level * 10 AS min_stock_level FROM {_ITEMS})
WHERE min_stock_level IS NOT NULL AND min_stock_level <> 0 AND quantity <= min_stock_level""")
def q_low_stock(spark, d):
    it = items(spark, d).withColumn("min_stock_level", F.col("min_stock_level") * 10)
    return inv.low_stock(it).select("id", "name", "category", "quantity", "min_stock_level")


@register("distinct_categories", sql=f"SELECT DISTINCT category FROM {_ITEMS}")
def q_distinct_categories(spark, d):
    return inv.distinct_values(items(spark, d), "category")


@register("distinct_suppliers", sql=f"SELECT DISTINCT supplier FROM {_ITEMS} WHERE supplier IS NOT NULL")
def q_distinct_suppliers(spark, d):
    return inv.distinct_values(items(spark, d), "supplier", drop_null=True)


@register("category_averages", sql=f"""
SELECT category, round(avg(quantity), 6) AS avg_quantity, round(avg(unit_price), 6) AS avg_price FROM {_ITEMS} GROUP BY category""")
def q_category_averages(spark, d):
    a = inv.category_averages(items(spark, d))
    return a.select("category", F.round("avg_quantity", 6).alias("avg_quantity"), F.round("avg_price", 6).alias("avg_price"))


@register("filter_inventory", sql=f"""
SELECT id, name, category, quantity FROM {_ITEMS}
WHERE lower(name) LIKE '%widget%' AND category = 'ECONOMY' AND quantity >= 100 AND quantity <= 2000""")
def q_filter_inventory(spark, d):
    f = inv.filter_items(items(spark, d), search="Widget", category="ECONOMY", min_quantity=100, max_quantity=2000)
    return f.select("id", "name", "category", "quantity")


@register("avg_stock_change", sql="""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS pos FROM events),
d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS diff FROM r WHERE pos <= 30),
c AS (SELECT user_id, count(*) AS rows FROM events GROUP BY user_id)
SELECT c.user_id, c.rows, round(CASE WHEN c.rows >= 30 THEN coalesce(a.m, 0.0) ELSE 0.0 END, 6) AS avg_stock_change
FROM c LEFT JOIN (SELECT user_id, avg(diff) AS m FROM d GROUP BY user_id) a ON a.user_id = c.user_id""")
def q_avg_stock_change(spark, d):
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    a = inv.avg_stock_change(ev, "user_id", "ts", "value", "event_id", 30)
    return a.withColumn("avg_stock_change", F.round("avg_stock_change", 6))


@register("inventory_forecast", sql=f"""
WITH it AS {_ITEMS},
r AS (SELECT quantity, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id) AS pos FROM it),
dd AS (SELECT quantity - lag(quantity) OVER (ORDER BY pos) AS diff FROM r WHERE pos <= 30),
ch AS (SELECT CASE WHEN (SELECT count(*) FROM it) >= 30 THEN coalesce(avg(diff), 0.0) ELSE 0.0 END AS delta FROM dd),
cats AS (SELECT category, avg(quantity) AS avg_quantity FROM it GROUP BY category),
days AS (SELECT CAST(i AS INTEGER) AS day_offset, CAST(DATE '{AS_OF}' + CAST(i AS INTEGER) AS DATE) AS date FROM range(0, 30) t(i))
SELECT date, day_offset, category,
       CAST(trunc(50 + delta * day_offset) AS BIGINT) AS incoming,
       CAST(trunc(CASE WHEN isodow(date) >= 6 THEN trunc(30 + delta * 0.8 * day_offset) * 1.3
                       ELSE trunc(30 + delta * 0.8 * day_offset) END) AS BIGINT) AS outgoing,
       CAST(trunc(avg_quantity * (1 + 0.05 * day_offset)) AS BIGINT) AS predicted_quantity,
       round(CAST(0.85 - 0.01 * day_offset AS DOUBLE), 6) AS confidence
FROM days, cats, ch""")
def q_inventory_forecast(spark, d):
    it = items(spark, d)
    ch = inv.avg_stock_change(it.withColumn("_all", F.lit(1)), "_all", "updated_at", "quantity", "id", 30) \
        .select("avg_stock_change")
    f = inv.inventory_forecast(it, ch, AS_OF, 30)
    return f.withColumn("confidence", F.round("confidence", 6))


def reorder_inputs(spark, d):
    part = table(spark, d, "part")
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    j = part.join(li, part.p_partkey == li.l_partkey, "left")
    return j.select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("tenant"),
        ((F.col("p_partkey") * 7) % 60).cast("long").alias("current_stock"),
        F.col("p_size").cast("long").alias("min_threshold"),
        (F.col("p_size") * 10 + 100).cast("long").alias("max_capacity"),
        F.round(F.col("p_retailprice") * 0.6, 2).alias("unit_cost"),
        F.round(F.coalesce("q", F.lit(0.0)) / 365, 4).alias("demand_rate"),
        (F.col("p_size") % 14 + 1).cast("long").alias("lead_time"))


_REORDER = """(SELECT p_partkey AS item_id, p_brand AS tenant, CAST((p_partkey * 7) % 60 AS BIGINT) AS current_stock,
        CAST(p_size AS BIGINT) AS min_threshold, CAST(p_size * 10 + 100 AS BIGINT) AS max_capacity,
        round(p_retailprice * 0.6, 2) AS unit_cost, round(coalesce(q, 0.0) / 365, 4) AS demand_rate,
        CAST(p_size % 14 + 1 AS BIGINT) AS lead_time
 FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""

# erf by the same Abramowitz–Stegun polynomial as the Spark side
_ERF = """(sign({x}) * (1 - (1.0 / (1 + 0.3275911 * abs({x}))) * (0.254829592 + (1.0 / (1 + 0.3275911 * abs({x})))
   * (-0.284496736 + (1.0 / (1 + 0.3275911 * abs({x}))) * (1.421413741 + (1.0 / (1 + 0.3275911 * abs({x})))
   * (-1.453152027 + (1.0 / (1 + 0.3275911 * abs({x}))) * 1.061405429)))) * exp(-({x}) * ({x}))))"""

_EOQ_CTE = f"""
WITH i AS {_REORDER},
e AS (SELECT *, CASE WHEN unit_cost * 0.2 > 0 THEN sqrt(2 * demand_rate * 365 * 50.0 / (unit_cost * 0.2)) ELSE min_threshold * 2.0 END AS eoq,
             1.96 * sqrt(lead_time * pow(demand_rate * 0.3, 2) + pow(demand_rate, 2) * pow(lead_time * 0.2, 2)) AS safety_stock FROM i),
f AS (SELECT *, CAST(trunc(demand_rate * lead_time + safety_stock) AS BIGINT) AS reorder_point,
             CAST(trunc(least(eoq, CAST(max_capacity - current_stock AS DOUBLE))) AS BIGINT) AS recommended_qty FROM e),
g AS (SELECT *, (current_stock - reorder_point) / (safety_stock + 1) AS z FROM f WHERE current_stock <= reorder_point),
recs AS (SELECT *, greatest(0.0, 1 - 0.5 * (1 + {_ERF.format(x="z / sqrt(2.0)")})) AS stockout_risk,
                recommended_qty * unit_cost AS cost_impact FROM g)
"""


def reorder_plan(spark, d):
    return inv.eoq_reorder(reorder_inputs(spark, d))


@register("eoq_reorder", sql=_EOQ_CTE + """
SELECT item_id, recommended_qty, reorder_point, round(safety_stock, 6) AS safety_stock,
       round(stockout_risk, 6) AS stockout_risk, round(cost_impact, 2) AS cost_impact FROM recs""")
def q_eoq_reorder(spark, d):
    r = reorder_plan(spark, d)
    return r.select("item_id", "recommended_qty", "reorder_point", F.round("safety_stock", 6).alias("safety_stock"),
                    F.round("stockout_risk", 6).alias("stockout_risk"), F.round("cost_impact", 2).alias("cost_impact"))


@register("budget_greedy", sql=_EOQ_CTE + f""",
o AS (SELECT tenant, item_id, round(cost_impact, 2) AS cost_impact,
             row_number() OVER (PARTITION BY tenant ORDER BY stockout_risk DESC, round(cost_impact, 2), item_id) AS rn
      FROM recs),
walk AS (
  WITH RECURSIVE w(tenant, rn, spent, item_id, taken) AS (
    SELECT DISTINCT tenant, CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE), CAST(NULL AS BIGINT), false FROM o
    UNION ALL
    SELECT o.tenant, o.rn,
           CASE WHEN o.cost_impact <= {BUDGET} - w.spent THEN w.spent + o.cost_impact ELSE w.spent END,
           o.item_id, o.cost_impact <= {BUDGET} - w.spent
    FROM w JOIN o ON o.tenant = w.tenant AND o.rn = w.rn + 1)
  SELECT * FROM w)
SELECT tenant, item_id FROM walk WHERE taken""")
def q_budget_greedy(spark, d):
    r = reorder_plan(spark, d).withColumn("cost_impact", F.round("cost_impact", 2))
    return inv.budget_select(r, "tenant", BUDGET).select("tenant", "item_id")
