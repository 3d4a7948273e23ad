"""Remaining inventory ids as their own queries: aspect sentiment, table
recovery, CV matching, profiling rules, model report pieces and the
source/sink variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import forecast as fc
from ledgerline.operators import layout, ml, profile, stats
from ledgerline.operators import text as TX
from ledgerline.plans import q_forecast, q_ml, q_text
from ledgerline.plans.q_general import word_boxes
from ledgerline.plans.registry import register
from ledgerline.session import ensure_checkpoint_dir, reliable_checkpoint
from ledgerline.sources import files
from ledgerline.sources.tables import table

# Fixed values (our own list): aspect terms looked for in reviews.
ASPECT_TERMS = ["price", "service", "quality", "delivery", "product", "staff", "support", "time"]
WINDOW = 5


def _valence_sql():
    return f"{q_text._VALS}[list_position({q_text._KEYS}, w)]"


@register("aspect_sentiment", sql=f"""
WITH tok AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w
             FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {q_text.PROFILES})),
asp AS (SELECT doc_id, pos, w AS aspect FROM tok WHERE w IN ({', '.join(repr(a) for a in ASPECT_TERMS)})),
ctx AS (SELECT a.doc_id, a.aspect, a.pos, o.off FROM asp a, (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS off) o WHERE o.off <> 0),
val AS (SELECT c.doc_id, c.aspect, c.pos, {_valence_sql()} AS v FROM ctx c JOIN tok t ON t.doc_id = c.doc_id AND t.pos = c.pos + c.off)
SELECT doc_id, aspect, count(DISTINCT pos) AS mentions, count(v) AS sentiment_words,
       round(CAST(coalesce(sum(v), 0.0) AS DOUBLE), 6) AS valence FROM val GROUP BY doc_id, aspect""")
def q_aspect_sentiment(spark, d):
    docs = q_text.profiles(spark, d)
    tok = docs.select("doc_id", F.posexplode_outer(T.words(F.lower(F.col("text")))).alias("pos", "w")) \
              .filter(F.col("w").isNotNull())
    tok = reliable_checkpoint(tok)            # read twice (aspects and context)
    asp = tok.filter(F.col("w").isin(*ASPECT_TERMS)).select("doc_id", "pos", F.col("w").alias("aspect"))
    # ±WINDOW neighbours as generated offsets, joined on (doc, position): bounded fan-out, no pair enumeration
    ctx = asp.withColumn("off", F.explode(F.array(*[F.lit(o) for o in range(-WINDOW, WINDOW + 1) if o != 0]))) \
             .withColumn("npos", F.col("pos") + F.col("off"))
    nb = tok.select("doc_id", F.col("pos").alias("npos"), F.col("w").alias("nw"))
    val = ctx.join(nb, ["doc_id", "npos"]).withColumn("v", TX._lex_map(0)[F.col("nw")])
    return val.groupBy("doc_id", "aspect").agg(
        F.count_distinct("pos").alias("mentions"), F.count("v").alias("sentiment_words"),
        F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 6).alias("valence"))


@register("table_from_words", sql="""
WITH l AS (SELECT doc_id, line_no - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                                                                    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
w AS (SELECT doc_id, line_no, word_no - 1 AS word_no, word FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(trim(line), ' +')) AS word,
                                                                        generate_subscripts(regexp_split_to_array(trim(line), ' +'), 1) AS word_no FROM l)
      WHERE word <> ''),
b AS (SELECT doc_id, word_no * 40.0 AS x, line_no * 20.0 + (word_no % 3) * 2.0 AS y, word AS text FROM w),
g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x)) > 10 THEN 1 ELSE 0 END AS brk FROM b),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_id FROM g),
c AS (SELECT doc_id, 0 AS pick, 'lines' AS method, line_no AS row_id,
             list_filter(list_transform(regexp_split_to_array(trim(line), '  +'), lambda s: trim(s)), lambda s: s <> '') AS cells
      FROM l WHERE trim(line) <> ''
      UNION ALL SELECT doc_id, 1, 'boxes', row_id, list(text ORDER BY x, text) FROM r GROUP BY doc_id, row_id),
e AS (SELECT doc_id, pick, count(*) AS n_rows, sum(len(cells)) AS n_cells, min(row_id) AS first_row FROM c GROUP BY doc_id, pick),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_cells DESC, pick) AS rk FROM e WHERE n_rows > 1),
h AS (SELECT t.doc_id, t.pick, t.n_rows, t.n_cells, t.first_row, min(c.cells) AS header
      FROM t JOIN c ON c.doc_id IS NOT DISTINCT FROM t.doc_id AND c.pick = t.pick AND c.row_id = t.first_row WHERE rk = 1 GROUP BY ALL)
SELECT c.doc_id, 'document ' || coalesce(CAST(c.doc_id AS VARCHAR), '') AS source, c.method, CAST(h.n_rows AS BIGINT) AS n_rows, CAST(h.n_cells AS BIGINT) AS n_cells,
       CAST(c.row_id AS BIGINT) AS row_id,
       array_to_string(list_transform(c.cells, lambda x, i: coalesce(h.header[i], 'Column ' || CAST(i AS VARCHAR)) || ': ' || x), chr(31)) AS record
FROM c JOIN h ON c.doc_id IS NOT DISTINCT FROM h.doc_id AND c.pick = h.pick WHERE c.row_id > h.first_row""")
def q_table_from_words(spark, d):
    """The records of every document's table, merged with their source.  A table is
    read from the lines (cells parted by two blanks) or from the word boxes (rows by
    their gaps); the reading with most cells and more than one row is taken."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_id", "_line")) \
        .filter(F.trim("_line") != "").select("doc_id", "row_id", layout.split_columns(F.trim("_line")).alias("cells"))
    boxes = layout.gap_rows(word_boxes(spark, d), "doc_id", "x", "y", "text", 10.0)
    t = layout.best_tables([("lines", lines), ("boxes", boxes)], "doc_id")
    source = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return t.select("doc_id", source.alias("source"), "method", "n_rows", "n_cells", "row_id",
                    F.array_join(layout.record("header", "cells"), "\u001f").alias("record"))


@register("cv_match", sql=q_text._TFIDF_CTE + f""",
req AS (SELECT item_id, string_split({q_text._skills_sql()}, ',') AS required, CASE WHEN item_id % 2 = 0 THEN 3.0 END AS min_exp,
               CASE WHEN item_id % 3 = 0 THEN 'Bachelor' END AS level FROM {q_text._phrased_sql('item_id', 'benchmark')}),
prof AS (SELECT doc_id, string_split({q_text._skills_sql()}, ',') AS skills, {q_text._exp_sql()} AS experience_years,
                regexp_extract_all(text, '{T.EDUCATION_PATTERNS[0]}', 0) || regexp_extract_all(text, '{T.EDUCATION_PATTERNS[1]}', 0) AS edu
         FROM {q_text.PROFILES}),
m AS (SELECT sim.item_id, sim.doc_id, score, list_filter(required, lambda x: x <> '') AS required, list_filter(skills, lambda x: x <> '') AS skills,
             min_exp IS NULL OR coalesce(experience_years >= min_exp, false) AS experience_match,
             level IS NULL OR len(list_filter(edu, lambda e: contains(lower(e), lower(level)))) > 0 AS education_match
      FROM sim JOIN req ON req.item_id = sim.item_id JOIN prof ON prof.doc_id = sim.doc_id WHERE score >= 0.05)
SELECT item_id, doc_id, round(score, 6) AS score, experience_match, education_match,
       array_to_string(list_filter(skills, lambda x: list_contains(required, x)), ',') AS matched,
       array_to_string(list_filter(required, lambda x: NOT list_contains(skills, x)), ',') AS missing
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rk
      FROM m WHERE experience_match AND education_match) WHERE rk <= 5""")
def q_cv_match(spark, d):
    """The five best candidates of every job among those that pass its minimum
    experience and education level, with matched and missing skills."""
    text = q_text.phrased("item_id")
    req = table(spark, d, "benchmark").select(
        "item_id", T.extract_skills(text).alias("required_skills"), F.when(F.col("item_id") % 2 == 0, 3.0).alias("min_experience"),
        F.when(F.col("item_id") % 3 == 0, "Bachelor").alias("education_level"))
    t = F.col("text")
    checked = [T.experience_years(t).alias("experience_years"), T.education(t).alias("education")]
    prof = reliable_checkpoint(q_text.profiles(spark, d).select("doc_id", *checked))
    req = reliable_checkpoint(req)
    # a pair is tested on two columns; skills are only looked for in the candidates that are given
    exp, edu = TX.requirement_checks()
    needs = req.select("item_id", "min_experience", "education_level")
    best = reliable_checkpoint(TX.top_similar(table(spark, d, "benchmark"), "item_id", "text", q_text.docs(spark, d), "doc_id", "text", 5, 0.05,
                                              keep=lambda pairs: pairs.join(needs, "item_id").join(prof, "doc_id").filter(exp & edu)))
    given = q_text.profiles(spark, d).join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    skilled = given.select("doc_id", T.extract_skills(t).alias("skills"), *checked)
    top = TX.match_requirements(best.join(req, "item_id").join(skilled, "doc_id"))
    return top.select("item_id", "doc_id", F.round("score", 6).alias("score"), "experience_match", "education_match",
                      F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


# ------------------------------------------------------------------ profiling rules

_ORDER_TYPES = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
                ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")]


def _prof_sql(tbl, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count(*) AS rows, count(DISTINCT {c}) AS d, "
                              f"{i} AS pos FROM {tbl}" for i, (c, t) in enumerate(cols))


@register("profile_demand_types", sql=f"""
SELECT "column", CASE WHEN data_type = 'datetime' THEN 'datetime'
                      WHEN d = 2 THEN 'boolean'
                      WHEN data_type IN ('integer', 'float') AND d > 1 AND d <= least(10, 0.05 * rows) THEN 'categorical'
                      WHEN data_type IN ('integer', 'float') THEN 'numeric'
                      WHEN d <= least(30, 0.2 * rows) THEN 'categorical' ELSE 'text' END AS kind
FROM ({_prof_sql('orders', _ORDER_TYPES)})""")
def q_profile_demand_types(spark, d):
    p = profile.profile_columns(table(spark, d, "orders"))
    dd, n = F.col("distinct_count"), F.col("rows")
    num = F.col("data_type").isin("integer", "float")
    kind = F.when(F.col("data_type") == "datetime", "datetime").when(dd == 2, "boolean") \
            .when(num & (dd > 1) & (dd <= F.least(F.lit(10.0), 0.05 * n)), "categorical").when(num, "numeric") \
            .when(dd <= F.least(F.lit(30.0), 0.2 * n), "categorical").otherwise("text")
    return p.select("column", kind.alias("kind"))


@register("profile_retention_types", sql=f"""
SELECT "column", CASE WHEN data_type = 'datetime' THEN 'date'
                      WHEN data_type IN ('integer', 'float') AND (d < 10 OR d / rows < 0.05) THEN 'categorical'
                      WHEN data_type IN ('integer', 'float') THEN 'numeric' ELSE 'categorical' END AS kind
FROM ({_prof_sql('orders', _ORDER_TYPES)})""")
def q_profile_retention_types(spark, d):
    p = profile.profile_columns(table(spark, d, "orders"))
    dd, n = F.col("distinct_count"), F.col("rows")
    num = F.col("data_type").isin("integer", "float")
    kind = F.when(F.col("data_type") == "datetime", "date").when(num & ((dd < 10) | (dd / n < 0.05)), "categorical") \
            .when(num, "numeric").otherwise("categorical")
    return p.select("column", kind.alias("kind"))


@register("detect_target_numeric", sql=f"""
SELECT arg_min("column", pos) AS target FROM ({_prof_sql('orders', _ORDER_TYPES)})
WHERE data_type IN ('integer', 'float') AND "column" NOT IN ('product_id', 'weather_code') AND d > 10 AND NOT contains("column", 'key')""")
def q_detect_target_numeric(spark, d):
    p = profile.profile_columns(table(spark, d, "orders"))
    c = p.filter(F.col("data_type").isin("integer", "float") & ~F.col("column").isin("product_id", "weather_code")
                 & (F.col("distinct_count") > 10) & ~F.col("column").contains("key"))
    return c.agg(F.min_by("column", "position").alias("target"))


@register("detect_basket_columns", sql="""
SELECT 'l_orderkey' AS transaction_column, 'p_brand' AS item_column,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS transactions, (SELECT count(DISTINCT p_brand) FROM part) AS items""")
def q_detect_basket_columns(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")) \
        .select("l_orderkey", "p_brand", "p_type")
    p = profile.profile_columns(reliable_checkpoint(li))
    # transaction: identifier-like (name has 'key' / 'id', most distinct); item: categorical string with most values
    tx = p.filter(F.lower("column").contains("key") | F.lower("column").contains("id")) \
          .agg(F.max_by("column", F.struct("distinct_count", "position")).alias("transaction_column"),
               F.max("distinct_count").alias("transactions"))
    it = p.filter((F.col("data_type") == "string") & (F.col("distinct_count") < F.col("rows"))) \
          .agg(F.max_by("column", F.struct("distinct_count", "position")).alias("item_column"),
               F.max("distinct_count").alias("items"))
    return tx.crossJoin(it).select("transaction_column", "item_column", "transactions", "items")


# ------------------------------------------------------------------ forecasting pieces

@register("trend_expsmooth")
def q_trend_expsmooth(spark, d):
    f = fc.fit_models(q_forecast.monthly_orders(spark, d), "series", "t", "y", horizon=12)
    return f.filter((F.col("kind") == "fit") & F.col("model").startswith("holt")).select("series", "model", "params", F.round("mae", 4).alias("mae"))


@register("trend_arima")
def q_trend_arima(spark, d):
    f = fc.fit_models(q_forecast.monthly_orders(spark, d), "series", "t", "y", horizon=12)
    return f.filter((F.col("kind") == "fit") & (F.col("model") == "arima")).select("series", "params", F.round("mae", 4).alias("mae"))


@register("trend_stationarity")
def q_trend_stationarity(spark, d):
    f = fc.fit_models(q_forecast.monthly_orders(spark, d), "series", "t", "y", horizon=1)
    return f.filter(F.col("kind") == "fit").groupBy("series").agg(F.first("stationary").alias("stationary"),
                                                                  F.first("seasonal").alias("seasonal"))


# ------------------------------------------------------------------ model pieces

@register("feat_pipeline_basic")
def q_feat_pipeline_basic(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = q_ml.churn_frame(spark, d)
    m = Pipeline(stages=ml.feature_stages(q_ml.CHURN_NUM, q_ml.CHURN_CAT)).fit(df)
    return m.transform(df).select("customer_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).alias("features"))


@register("price_drivers")
def q_price_drivers(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_brand", "p_type",
                                          F.col("p_retailprice").alias("label"))
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("sales"), F.avg("l_discount").alias("discount"))
    df = part.join(li, part.p_partkey == li.l_partkey, "left").fillna({"sales": 0.0, "discount": 0.0})
    model = ml.fit_forest(df, ["p_size", "sales", "discount"], ["p_type"], "p_partkey", trees=50)
    return ml.feature_importance(model, df, 20).withColumn("importance", F.round("importance", 4))


@register("inventory_model_score")
def q_inventory_model_score(spark, d):
    from ledgerline.plans.q_inventory import items
    it = items(spark, d).select("id", F.col("quantity").cast("double").alias("label"), "unit_price",
                                F.col("min_stock_level").cast("double").alias("min_level"), "category")
    it = it.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(5)))
    # the target is not among the features (the quantity leak is not reproduced)
    model = ml.fit_forest(it.filter("_b <> 0"), ["unit_price", "min_level"], ["category"], "id")
    r2 = stats.regression_metrics(model.transform(it.filter("_b = 0")), "label", "prediction").first()["r2"]
    return it.sparkSession.createDataFrame([(round(float(r2), 4),)], "r2 double").crossJoin(it.agg(F.count(F.lit(1)).alias("items")))


@register("retention_score")
def q_retention_score(spark, d):
    train, test = q_ml._split(q_ml.quality_frame(spark, d), "doc_id")
    _, best = ml.train_classifiers(train, test, q_ml.QUAL_NUM, q_ml.QUAL_CAT, "doc_id", ml.CHURN_GRIDS, metric="f1", only=["logistic_regression"])
    every = reliable_checkpoint(q_ml.quality_frame(spark, d, labelled=False).drop("label"))
    s = ml.score_binary(best, every, "doc_id")
    p = F.col("probability")
    s = s.withColumn("label", F.when(F.col("predicted") == 1, "Leave").otherwise("Stay")) \
         .withColumn("confidence", F.round(F.greatest(p, 1 - p), 4)).withColumn("stay_probability", F.round(1 - p, 4)) \
         .withColumn("probability", F.round(p, 4))
    return s.join(ml.top_factors(best, every, "doc_id", 5), "doc_id")


@register("model_report")
def q_model_report(spark, d):
    train, test = q_ml._split(q_ml.churn_frame(spark, d), "customer_id")
    metrics, best = ml.train_classifiers(train, test, q_ml.CHURN_NUM, q_ml.CHURN_CAT, "customer_id", ml.CHURN_GRIDS,
                                         only=["random_forest", "logistic_regression"])
    m = metrics.select(F.lit("metric").alias("section"), F.col("model").alias("name"), F.round("f1", 4).alias("value"))
    imp = ml.feature_importance(best, train, 10).select(F.lit("importance").alias("section"), F.col("feature").alias("name"),
                                                        F.round("importance", 4).alias("value"))
    return m.unionByName(imp)


@register("model_compare")
def q_model_compare(spark, d):
    from ledgerline.plans.q_ml import q_pricing_model
    return q_pricing_model(spark, d)


# ------------------------------------------------------------------ source / sink variants

@register("sink_csv", sql="SELECT c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def q_sink_csv(spark, d):
    p = ensure_checkpoint_dir(spark).rstrip("/") + f"/io/customer-{uuid.uuid4().hex}"
    files.sink_csv(table(spark, d, "customer").select("c_name", "c_custkey", "c_nationkey", "c_mktsegment"), p)
    return spark.read.option("header", True).schema("c_custkey long, c_mktsegment string, c_name string, c_nationkey int").csv(p)


@register("scan_csv_dates", sql="SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def q_scan_csv_dates(spark, d):
    p = ensure_checkpoint_dir(spark).rstrip("/") + f"/io/orders-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("o_orderdate"))
    o.write.option("header", True).csv(p)
    r = files.scan_csv(spark, p, schema="o_orderkey long, o_orderdate string")
    return r.select("o_orderkey", F.to_date(F.try_to_timestamp("o_orderdate", F.lit("M/d/yyyy"))).alias("order_date"))


@register("scan_documents", sql="SELECT CAST(doc_id AS VARCHAR) AS _id, lang, source FROM documents")
def q_scan_documents(spark, d):
    p = ensure_checkpoint_dir(spark).rstrip("/") + f"/io/documents-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "lang", "source").write.json(p)
    return files.scan_json(spark, p).select(F.col("_id").cast("string").alias("_id"), "lang", "source")


@register("trend_sarimax")
def q_trend_sarimax(spark, d):
    """Quantity by return flag and month: a seasonal fit where the ACF shows
    one, else a small ARIMA (series of 24 months and more)."""
    monthly = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series"),
                                                  F.date_trunc("month", "l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("y"))
    f = fc.fit_models(monthly, "series", "t", "y", horizon=12)
    return f.filter((F.col("kind") == "fit") & (F.col("model") == "sarimax")).select("series", "model", "params", F.round("mae", 4).alias("mae"), "seasonal")


@register("feat_pipeline_robust")
def q_feat_pipeline_robust(spark, d):
    """Median imputation + robust scaling of numerics, date parts,
    ordinal code of the priority, one-hot status (pyspark.ml stages)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from ledgerline.functions import scalars as S
    o = table(spark, d, "orders")
    x = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"),
                 S.ordinal_encode("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).cast("double").alias("priority"),
                 "o_orderstatus", *[c.cast("double").alias(k) for k, c in S.date_features("o_orderdate").items()])
    stages = [Imputer(inputCols=["price"], outputCols=["price_f"], strategy="median"),
              StringIndexer(inputCol="o_orderstatus", outputCol="status_idx", handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCol="status_idx", outputCol="status_ohe", handleInvalid="keep"),
              VectorAssembler(inputCols=["price_f", "priority", "month", "day_of_week", "quarter"], outputCol="num"),
              RobustScaler(inputCol="num", outputCol="num_scaled", withCentering=True, withScaling=True),
              VectorAssembler(inputCols=["num_scaled", "status_ohe", "is_weekend", "is_month_end"], outputCol="features")]
    m = Pipeline(stages=stages).fit(x)
    return m.transform(x).select("o_orderkey", F.transform(vector_to_array("features"), lambda v: F.round(v, 4)).alias("features"))


@register("batch_status_join", sql="""
WITH tasks AS (SELECT conv_id AS batch_id, turn AS task_id FROM conversations),
results AS (SELECT conv_id AS batch_id, turn AS task_id, CASE WHEN role = 'assistant' THEN 'completed' END AS status
            FROM conversations WHERE role = 'assistant')
SELECT t.batch_id, t.task_id, coalesce(r.status, 'unknown') AS status
FROM tasks t LEFT JOIN results r ON r.batch_id = t.batch_id AND r.task_id = t.task_id""")
def q_batch_status_join(spark, d):
    """Tasks = turns of a conversation (the batch), results = assistant turns;
    missing results → 'unknown'."""
    c = table(spark, d, "conversations")
    tasks = c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("task_id"))
    results = c.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("task_id"),
                                                            F.lit("completed").alias("status"))
    return tasks.join(results, ["batch_id", "task_id"], "left").select(
        "batch_id", "task_id", F.coalesce("status", F.lit("unknown")).alias("status"))


@register("scan_textdir", sql="SELECT doc_id, length(text) AS n_chars FROM documents")
def q_scan_textdir(spark, d):
    """A folder of text files that hold many documents each (id, unit
    separator, text, record separator), read back as one row per document."""
    p = ensure_checkpoint_dir(spark).rstrip("/") + f"/io/textdir-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    files.sink_text_records(docs.select(F.concat_ws(files.UNIT, F.col("doc_id").cast("string"), "text").alias("value")), p)
    r = files.scan_text_records(spark, p).select(F.split("text", files.UNIT, 2).alias("v"))
    return r.select(F.col("v")[0].cast("long").alias("doc_id"), F.length(F.col("v")[1]).alias("n_chars"))
