"""Profiling, cleaning, windows, metrics and set operations bound to the
driver tables.  Where an input needs gaps (the tables have no nulls) the
gaps are made by a rule on the key, identically on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import inventory, clean, layout, profile, stats
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table

# ------------------------------------------------------------------ profiling

_CUSTOMER_TYPES = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                   ("c_acctbal", "float"), ("c_mktsegment", "string")]


def _profile_sql(tbl, cols):
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count(*) AS rows, count(DISTINCT {c}) AS distinct_count, "
             f"count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM {tbl}" for c, t in cols]
    return " UNION ALL ".join(parts)


@register("profile_columns", sql=_profile_sql("customer", _CUSTOMER_TYPES))
def q_profile_columns(spark, d):
    return profile.profile_columns(table(spark, d, "customer")).drop("position")


@register("profile_basket_flags", sql=f"""
SELECT "column", data_type, data_type IN ('integer', 'float') AS is_numeric, data_type = 'datetime' AS is_datetime,
       distinct_count <= 30 AS is_categorical,
       distinct_count > 0.8 * rows OR contains(lower("column"), 'id') AS is_identifier
FROM ({_profile_sql('customer', _CUSTOMER_TYPES)})""")
def q_profile_flags(spark, d):
    p = profile.basket_flags(profile.profile_columns(table(spark, d, "customer")))
    return p.select("column", "data_type", "is_numeric", "is_datetime", "is_categorical", "is_identifier")


_PART_TYPES = [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
               ("p_size", "integer"), ("p_retailprice", "float")]


@register("profile_pricing", sql=f"""
SELECT "column", CASE WHEN data_type IN ('integer', 'float') AND distinct_count < 10 AND distinct_count / rows < 0.05 THEN 'categorical'
                      WHEN data_type IN ('integer', 'float') THEN 'numeric'
                      WHEN distinct_count < 10 OR distinct_count / rows < 0.5 THEN 'categorical' ELSE 'text' END AS role,
       data_type IN ('integer', 'float') AND (contains(lower("column"), 'price') OR contains(lower("column"), 'cost')
            OR contains(lower("column"), 'value') OR contains(lower("column"), 'amount')) AS possible_target,
       round(missing_count / rows * 100, 6) AS missing_pct
FROM ({_profile_sql('part', _PART_TYPES)})""")
def q_profile_pricing(spark, d):
    p = profile.pricing_roles(profile.profile_columns(table(spark, d, "part")))
    return p.select("column", "role", "possible_target", F.round("missing_pct", 6).alias("missing_pct"))


@register("data_quality", sql="""
SELECT rows, unique_rows, round((1 - nulls / (rows * 4)) * 100, 6) AS completeness_pct,
       round((rows - unique_rows) / rows * 100, 6) AS duplicate_pct
FROM (SELECT count(*) AS rows,
             count(*) FILTER (WHERE o_custkey IS NULL) + count(*) FILTER (WHERE o_orderstatus IS NULL)
           + count(*) FILTER (WHERE o_orderpriority IS NULL) + count(*) FILTER (WHERE o_orderdate IS NULL) AS nulls
      FROM orders),
     (SELECT count(*) AS unique_rows FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders))""")
def q_data_quality(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    q = profile.data_quality(o)
    return q.select("rows", "unique_rows", F.round("completeness_pct", 6).alias("completeness_pct"),
                    F.round("duplicate_pct", 6).alias("duplicate_pct"))


_EDA_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("eda_describe", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem""" for c in _EDA_COLS))
def q_eda_describe(spark, d):
    li = table(spark, d, "lineitem").withColumn("_id", F.struct("l_orderkey", "l_linenumber"))
    x = profile.describe(li, _EDA_COLS, "_id")
    return x.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("target_distribution", sql="""
SELECT o_orderstatus, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct FROM orders GROUP BY 1""")
def q_target_distribution(spark, d):
    t = profile.target_distribution(table(spark, d, "orders"), "o_orderstatus")
    return t.withColumn("pct", F.round("pct", 6))


@register("validate_binary_target", sql="""
SELECT count(*) AS rows, count(*) FILTER (WHERE quality NOT IN (0, 1) OR quality IS NULL) AS invalid,
       min(quality) AS min_value, max(quality) AS max_value,
       count(*) FILTER (WHERE quality NOT IN (0, 1) OR quality IS NULL) = 0 AND min(quality) = 0 AND max(quality) = 1 AS valid
FROM labels""")
def q_validate_binary_target(spark, d):
    return profile.validate_binary_target(table(spark, d, "labels"), "quality")


@register("distinct_count", sql="""
SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus,
       count(DISTINCT o_orderpriority) AS o_orderpriority, count(DISTINCT o_orderdate) AS o_orderdate FROM orders""")
def q_distinct_count(spark, d):
    o = table(spark, d, "orders")
    names = ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    p = profile.profile_columns(o.select(*names))
    return p.agg(*[F.max(F.when(F.col("column") == c, F.col("distinct_count"))).alias(c) for c in names])


# ------------------------------------------------------------------ cleaning

def _gappy_lineitem(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.withColumn("q", F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity"))) \
             .withColumn("_id", F.struct("l_orderkey", "l_linenumber"))


_GAPPY = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)"


@register("impute_values", sql=f"""
SELECT round(avg(q), 6) AS mean, round(quantile_cont(q, 0.5), 6) AS median,
       (SELECT q FROM {_GAPPY} WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1) AS mode
FROM {_GAPPY}""")
def q_impute_values(spark, d):
    v = clean.impute_values(_gappy_lineitem(spark, d), "q", "_id")
    return v.select(F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "mode")


@register("impute_mean", sql=f"""
SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM {_GAPPY})), 6) AS q FROM {_GAPPY}""")
def q_impute_mean(spark, d):
    x = clean.impute(_gappy_lineitem(spark, d), "q", "_id", "mean")
    return x.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@register("impute_median", sql=f"""
SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT quantile_cont(q, 0.5) FROM {_GAPPY})), 6) AS q FROM {_GAPPY}""")
def q_impute_median(spark, d):
    x = clean.impute(_gappy_lineitem(spark, d), "q", "_id", "median")
    return x.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@register("impute_mode", sql=f"""
SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT q FROM {_GAPPY} WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) AS q
FROM {_GAPPY}""")
def q_impute_mode(spark, d):
    x = clean.impute(_gappy_lineitem(spark, d), "q", "_id", "mode")
    return x.select("l_orderkey", "l_linenumber", "q")


@register("clean_numeric_alpha", sql="""
SELECT event_id, CAST(round_even(coalesce(TRY_CAST(CASE WHEN regexp_matches(raw, '[a-zA-Z]') THEN NULL ELSE raw END AS DOUBLE), 0.0), 0) AS BIGINT) AS cleaned
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(value AS VARCHAR) || 'x' ELSE CAST(value AS VARCHAR) END AS raw FROM events)""")
def q_clean_numeric_alpha(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("value").cast("string"), F.lit("x"))).otherwise(F.col("value").cast("string"))
    return e.select("event_id", S.clean_numeric_alpha(raw).alias("cleaned"))


@register("clean_bool", sql="""
SELECT doc_id, CASE WHEN lower(trim(raw)) IN ('true', '1', '1.0', 'yes') THEN true
                    WHEN lower(trim(raw)) IN ('false', '0', '0.0', 'no') THEN false END AS toxic_flag
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'True' WHEN doc_id % 3 = 0 THEN 'maybe' ELSE '0' END AS raw FROM labels)""")
def q_clean_bool(spark, d):
    lb = table(spark, d, "labels")
    raw = F.when(F.col("toxic") == 1, "True").when(F.col("doc_id") % 3 == 0, "maybe").otherwise("0")
    return lb.select("doc_id", S.clean_bool(raw).alias("toxic_flag"))


@register("clean_dates", sql="""
SELECT o_orderkey, CAST(try_strptime(raw, '%Y-%m-%d') AS DATE) AS order_date
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
WHERE try_strptime(raw, '%Y-%m-%d') IS NOT NULL""")
def q_clean_dates(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    x = o.select("o_orderkey", F.to_date(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))).alias("order_date"))
    return clean.drop_key_nulls(x, ["order_date"])


@register("date_features", sql="""
SELECT o_orderkey, isodow(o_orderdate) - 1 AS day_of_week, month(o_orderdate) AS month, day(o_orderdate) AS day,
       year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
       CAST(day(o_orderdate) = 1 AS INTEGER) AS is_month_start,
       CAST(CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS INTEGER) AS is_month_end FROM orders""")
def q_date_features(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[c.alias(k) for k, c in S.date_features("o_orderdate").items()])


@register("season_holiday", sql=f"""
SELECT event_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 4 WHEN month(ts) IN (3, 4, 5) THEN 2 WHEN month(ts) IN (6, 7, 8) THEN 1 ELSE 3 END AS weather_code,
       isodow(ts) >= 6 OR strftime(ts, '%Y-%m-%d') IN ({', '.join(repr(h) for h in S.US_HOLIDAYS)}) AS is_holiday FROM events""")
def q_season_holiday(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.season_weather("ts").alias("weather_code"), S.is_holiday("ts").alias("is_holiday"))


@register("ordinal_encode", sql="""
SELECT o_orderkey, coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) - 1, -1) AS priority_code FROM orders""")
def q_ordinal_encode(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.ordinal_encode("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("priority_code"))


@register("binary_label", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders""")
def q_binary_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clean.binary_label("o_orderstatus", "F").alias("label"))


@register("parse_schedule_json", sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_parse_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("json_rows", sql="""
SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record
FROM nation""")
def q_json_rows(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("record"))


@register("null_to_blank", sql="""
SELECT CAST(id AS VARCHAR) AS id, coalesce(CAST(supplier AS VARCHAR), '') AS supplier
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN s_name END AS supplier FROM part
      LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
      LEFT JOIN supplier ON s_suppkey = sk)""")
def q_null_to_blank(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("sk"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    x = part.join(li, part.p_partkey == li.l_partkey, "left").join(s, F.col("sk") == s.s_suppkey, "left") \
        .select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("s_name")).alias("supplier"))
    return clean.null_to_blank(x)


# ------------------------------------------------------------------ windows, sorts, limits

@register("window_share", sql="""
SELECT c_nationkey, round(sum(o_totalprice), 2) AS revenue,
       round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER () * 100, 6) AS share_pct
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def q_window_share(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rev = o.groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("revenue"))
    s = stats.share(rev, "revenue", out="share_pct")
    return s.select("c_nationkey", F.round("revenue", 2).alias("revenue"), F.round("share_pct", 6).alias("share_pct"))


@register("topk", sql="""
SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 10""")
def q_topk(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return o.orderBy(F.desc("spend"), "o_custkey").limit(10)


@register("offset_limit", sql="SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def q_offset_limit(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(10).limit(20)


@register("preview_table", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 10""")
def q_preview_table(spark, d):
    o = table(spark, d, "orders")
    total = o.agg(F.count(F.lit(1)).alias("total_rows"))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(10).crossJoin(total)


@register("arg_best", sql="""
SELECT event_type, arg_max(user_id, struct_pack(v := v, neg_user := -user_id)) AS best_user, round(max(v), 4) AS best_value
FROM (SELECT event_type, user_id, sum(value) AS v FROM events GROUP BY 1, 2) GROUP BY event_type""")
def q_arg_best(spark, d):
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return e.groupBy("event_type").agg(F.max_by("user_id", F.struct("v", (-F.col("user_id")).alias("neg_user"))).alias("best_user"),
                                       F.round(F.max("v"), 4).alias("best_value"))


@register("quantile_agg", sql="""
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY event_type""")
def q_quantile_agg(spark, d):
    q = stats.exact_group_quantiles(table(spark, d, "events"), "event_type", "value", "event_id", [0.05, 0.95], "q")
    return q.select("event_type", "n", F.round(F.col("q")[0], 6).alias("p05"), F.round(F.col("q")[1], 6).alias("p95"))


@register("forecast_rollup", sql="""
SELECT round(sum(v), 4) AS total, round(avg(v), 4) AS mean, arg_max(day, v) AS peak_day, round(max(v), 4) AS peak_value
FROM (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1)""")
def q_forecast_rollup(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return daily.agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v"), 4).alias("mean"),
                     F.max_by("day", "v").alias("peak_day"), F.round(F.max("v"), 4).alias("peak_value"))


@register("job_stats", sql="""
SELECT event_type, count(*) AS records, count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') >= 7) AS older_than_7d
FROM events GROUP BY event_type""")
def q_job_stats(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("records"),
                                       F.count_if(F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) >= 7).alias("older_than_7d"))


# ------------------------------------------------------------------ set operations, lookups

@register("dedup_rows", sql="SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def q_dedup_rows(spark, d):
    return clean.dedup_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"))


@register("union_with_source", sql="""
SELECT 'customer' AS Source, c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier""")
def q_union_with_source(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                                           F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return clean.union_with_source({"customer": c, "supplier": s})


@register("lookup_rows", sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def q_lookup_rows(spark, d):
    ids = table(spark, d, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")) \
        .select(F.col("o_custkey").alias("c_custkey"))
    found, _ = inventory.lookup_rows(
        table(spark, d, "customer").select("c_custkey", "c_name"), ids, "c_custkey")
    return found


@register("lookup_unknown", sql="""
SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def q_lookup_unknown(spark, d):
    from ledgerline.operators.inventory import lookup_rows
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    base = table(spark, d, "customer").filter(F.col("c_mktsegment") != "BUILDING").select("c_custkey")
    _, unknown = lookup_rows(base, ids, "c_custkey")
    return unknown


# ------------------------------------------------------------------ layout (word boxes from document lines)

def word_boxes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.posexplode(F.split(F.trim("line"), " +")).alias("word_no", "word")) \
        .filter(F.col("word") != "")
    # y jitters by up to 4 px inside a line; lines are 20 px apart (> 10 px gap)
    return words.select("doc_id", (F.col("word_no") * 40.0).alias("x"),
                        (F.col("line_no") * 20.0 + (F.col("word_no") % 3) * 2.0).alias("y"),
                        F.col("word").alias("text"))


@register("gap_rows", sql="""
WITH l AS (SELECT doc_id, line_no - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                                                                    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
w AS (SELECT doc_id, line_no, word_no - 1 AS word_no, word FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(trim(line), ' +')) AS word,
                                                                        generate_subscripts(regexp_split_to_array(trim(line), ' +'), 1) AS word_no FROM l)
      WHERE word <> ''),
b AS (SELECT doc_id, word_no * 40.0 AS x, line_no * 20.0 + (word_no % 3) * 2.0 AS y, word AS text FROM w),
g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x)) > 10 THEN 1 ELSE 0 END AS brk FROM b),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_id FROM g)
SELECT doc_id, row_id, count(*) AS n_cells, arg_min(text, x) AS first_cell FROM r GROUP BY doc_id, row_id""")
def q_gap_rows(spark, d):
    rows = layout.gap_rows(word_boxes(spark, d), "doc_id", "x", "y", "text", 10.0)
    return rows.select("doc_id", F.col("row_id").cast("long").alias("row_id"), F.size("cells").cast("long").alias("n_cells"),
                       F.col("cells")[0].alias("first_cell"))


@register("split_columns", sql="""
SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(CASE WHEN turn % 2 = 0 THEN replace(text, ' ', '  ') ELSE text END, '  +'), lambda s: trim(s)), lambda s: s <> '')) AS n_cells
FROM conversations""")
def q_split_columns(spark, d):
    c = table(spark, d, "conversations")
    # every other turn as a table row: cells parted by two blanks
    c = c.withColumn("text", F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.size(layout.split_columns("text")).alias("n_cells"))


@register("sheet_name", sql=r"""
SELECT page_id, substr(translate(regexp_replace(url, '\.[^.]*$', ''), '[]:*?/\', ''), 1, 31) AS sheet FROM pages""")
def q_sheet_name(spark, d):
    return table(spark, d, "pages").select("page_id", layout.sheet_name("url").alias("sheet"))
