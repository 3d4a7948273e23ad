"""Inventory: overview, low stock, filters, row maintenance, trends,
forecast spine, EOQ reorder plan, budget selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import normal_cdf
from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint

# The columns of an inventory table, in order.
INVENTORY_COLUMNS = ["id", "name", "category", "quantity", "unit_price", "supplier",
                     "min_stock_level", "last_restock_date", "created_at", "updated_at"]


def overview_by_category(items: DataFrame) -> DataFrame:
    value = F.col("quantity") * F.col("unit_price")
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.sum(value).alias("value"))


def overview_totals(items: DataFrame) -> DataFrame:
    value = F.col("quantity") * F.col("unit_price")
    return items.agg(F.count(F.lit(1)).alias("total_items"), F.sum(value).alias("total_value"),
                     F.count_distinct("category").alias("categories"))


def low_stock(items: DataFrame) -> DataFrame:
    m = F.col("min_stock_level")
    return items.filter(m.isNotNull() & (m != 0) & (F.col("quantity") <= m))


def filter_items(items: DataFrame, search: str | None = None, category: str | None = None,
                 min_quantity=None, max_quantity=None) -> DataFrame:
    """Conjunction of the optional filters; search is a case-insensitive
    substring of the name (pushed to the scan as far as Catalyst can)."""
    cond = F.lit(True)
    if search:
        cond = cond & F.lower(F.col("name")).contains(search.lower())
    if category is not None:
        cond = cond & (F.col("category") == category)
    if min_quantity is not None:
        cond = cond & (F.col("quantity") >= min_quantity)
    if max_quantity is not None:
        cond = cond & (F.col("quantity") <= max_quantity)
    return items.filter(cond)


def distinct_values(items: DataFrame, col: str, drop_null: bool = False) -> DataFrame:
    d = items.select(col).distinct()
    return d.dropna() if drop_null else d


def category_averages(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.avg("quantity").alias("avg_quantity"),
                                         F.avg("unit_price").alias("avg_price"))


# ------------------------------------------------------------ row maintenance (batch form)

def insert_rows(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new, allowMissingColumns=True)


def patch_rows(base: DataFrame, patch: DataFrame, key: str = "id", stamp_col: str | None = "updated_at",
               stamp_value=None) -> DataFrame:
    """Overwrite only the non-null fields of each patch row; stamp
    ``stamp_col`` on patched rows."""
    p = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key])
    j = base.join(p, key, "left")
    hit = F.lit(False)
    for c in patch.columns:
        if c != key:
            hit = hit | F.col(f"_new_{c}").isNotNull()
    out = []
    for c in base.columns:
        if c in patch.columns and c != key:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        elif stamp_col and c == stamp_col and stamp_value is not None:
            out.append(F.when(hit, F.lit(stamp_value)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def delete_rows(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def lookup_rows(base: DataFrame, ids: DataFrame, key: str = "id"):
    """(found rows, unknown ids) for a batch of ids."""
    k = ids.select(key).distinct()
    return base.join(k, key, "left_semi"), k.join(base.select(key), key, "left_anti")


def import_merge(base: DataFrame, incoming: DataFrame, strategy: str = "append",
                 required=("name", "category", "quantity", "unit_price"), stamp=None) -> DataFrame:
    """Check required columns, add missing optional ones, stamp a
    deterministic id (md5 of the row) and created/updated, then append to or
    replace ``base``."""
    missing = [c for c in required if c not in incoming.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    x = incoming
    for c in INVENTORY_COLUMNS:
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast("string"))
    x = x.withColumn("id", F.coalesce(F.col("id"), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in required]))))
    if stamp is not None:
        x = x.withColumn("created_at", F.coalesce(F.col("created_at"), F.lit(stamp))) \
             .withColumn("updated_at", F.lit(stamp))
    x = x.select(*[c for c in INVENTORY_COLUMNS])
    if strategy == "replace":
        return x
    return base.unionByName(x, allowMissingColumns=True)


# ------------------------------------------------------------ trends and forecast

def avg_stock_change(df: DataFrame, keys, order_col: str, value_col: str, id_col: str, n: int = 30) -> DataFrame:
    """Per key: mean first difference of ``value_col`` over its ``n`` newest
    rows taken newest first (x_i − x_{i−1} in that order); 0 when the key has
    fewer than ``n`` rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    newest = stats.top_n_per_key(df, keys, [F.desc(order_col), F.col(id_col)], n, rank_col="_pos")
    w = Window.partitionBy(*keys).orderBy("_pos")   # ≤ n rows per key
    d = newest.withColumn("_diff", F.col(value_col) - F.lag(value_col).over(w))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    a = d.groupBy(*keys).agg(F.avg("_diff").alias("_avg"))
    return counts.join(a, keys, "left").select(
        *keys, "rows", F.when(F.col("rows") >= n, F.coalesce(F.col("_avg"), F.lit(0.0))).otherwise(F.lit(0.0))
        .alias("avg_stock_change"))


def inventory_forecast(items: DataFrame, change: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per day i in 0..days−1 from ``as_of`` and per category:
    incoming = int(50 + Δ·i), outgoing = int(int(30 + 0.8·Δ·i) × 1.3 on
    weekends), predicted = int(avg_qty × (1 + 0.05 i)), confidence 0.85 − 0.01 i.
    ``change`` is a one-row DataFrame with column avg_stock_change (Δ)."""
    cats = category_averages(items).crossJoin(change.select("avg_stock_change"))   # 1-row side
    # the day spine is a generated column, not a join
    out = cats.withColumn("day_offset", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))) \
              .withColumn("date", F.date_add(F.to_date(F.lit(as_of)), F.col("day_offset")))
    i = F.col("day_offset")
    d = F.col("avg_stock_change")
    weekend = F.weekday("date") >= 5
    return out.select(
        "date", "day_offset", "category",
        (F.lit(50) + d * i).cast("long").alias("incoming"),
        (F.when(weekend, (F.lit(30) + d * 0.8 * i).cast("long") * 1.3)
          .otherwise((F.lit(30) + d * 0.8 * i).cast("long"))).cast("long").alias("outgoing"),
        (F.col("avg_quantity") * (1 + 0.05 * i)).cast("long").alias("predicted_quantity"),
        (F.lit(0.85) - 0.01 * i).alias("confidence"))


# ------------------------------------------------------------ reorder planning

def eoq_reorder(items: DataFrame, ordering_cost: float = 50.0, holding_rate: float = 0.2,
                z: float = 1.96) -> DataFrame:
    """EOQ, safety stock, reorder point, order quantity and stock-out risk
    for items at or below their reorder point.  Inputs: id, current_stock,
    min_threshold, max_capacity, unit_cost, demand_rate, lead_time."""
    d, L, c = F.col("demand_rate"), F.col("lead_time"), F.col("unit_cost")
    hold = c * holding_rate
    eoq = F.when(hold > 0, F.sqrt(2 * d * 365 * ordering_cost / hold)).otherwise(F.col("min_threshold") * 2.0)
    safety = z * F.sqrt(L * F.pow(d * 0.3, 2) + F.pow(d, 2) * F.pow(L * 0.2, 2))
    x = items.withColumn("eoq", eoq).withColumn("safety_stock", safety) \
             .withColumn("reorder_point", (d * L + F.col("safety_stock")).cast("long")) \
             .withColumn("recommended_qty", F.least(F.col("eoq"), (F.col("max_capacity") - F.col("current_stock")).cast("double")).cast("long"))
    x = x.filter(F.col("current_stock") <= F.col("reorder_point"))
    zc = (F.col("current_stock") - F.col("reorder_point")) / (F.col("safety_stock") + 1)
    return x.withColumn("stockout_risk", F.greatest(F.lit(0.0), 1 - normal_cdf(zc))) \
            .withColumn("cost_impact", F.col("recommended_qty") * c)


def budget_select(recs: DataFrame, tenant_col: str, budget: float) -> DataFrame:
    """Greedy budget walk per tenant in (−risk, cost, id) order: an item is
    taken when it still fits in what is left (later, smaller items can still
    be taken after a skip).  Running sums come from ``stats.keyed_running_sum``
    (global numbering), so one tenant with most candidates is still spread.

    Distributed rounds, every tenant in parallel: take the longest prefix of
    the remaining candidates whose running cost fits the remaining budget
    (running sums over candidates only), drop the first non-fitting item and
    everything that no longer fits, repeat.  Each round settles at least one
    item of every tenant that has any, so the loop ends by itself; it has no
    round limit.  A round's picks are one written table, united at the end.
    Money is DECIMAL with six places throughout."""
    money = "decimal(28,6)"
    cand = recs.withColumn("_remaining", F.lit(float(budget)).cast(money)) \
               .withColumn("_cost", F.col("cost_impact").cast(money))
    cand = reliable_checkpoint(cand.filter(F.col("_cost") <= F.col("_remaining")))
    rounds = []
    while not cand.isEmpty():
        # running cost per tenant without a per-tenant window (skew-safe)
        run = reliable_checkpoint(stats.keyed_running_sum(
            cand, [tenant_col], [F.desc("stockout_risk"), F.col("cost_impact"), F.col("item_id")], "_cost", "_cum"))
        fit = run.filter(F.col("_cum") <= F.col("_remaining"))
        spent = fit.groupBy(tenant_col).agg(F.sum("_cost").cast(money).alias("_spent"))
        key = F.struct((-F.col("stockout_risk")).alias("a"), F.col("cost_impact").alias("b"),
                       F.col("item_id").alias("c"))
        first_bad = run.filter(F.col("_cum") > F.col("_remaining")) \
            .groupBy(tenant_col).agg(F.min(key).alias("_fbk"))
        rounds.append(fit.drop("_cum"))
        rest = run.filter(F.col("_cum") > F.col("_remaining")).drop("_cum") \
            .join(spent, tenant_col, "left").join(first_bad.select(tenant_col, "_fbk"), tenant_col, "left")
        rest = rest.withColumn("_remaining", (F.col("_remaining") - F.coalesce(F.col("_spent"), F.lit(0))).cast(money)) \
                   .filter(key > F.col("_fbk")) \
                   .filter(F.col("_cost") <= F.col("_remaining")) \
                   .drop("_spent", "_fbk")
        cand = reliable_checkpoint(rest)
    taken = cand
    for part in rounds:
        taken = taken.unionByName(part)
    return taken.drop("_remaining", "_cost")
