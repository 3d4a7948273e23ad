"""Forecast analyses: daily quantity per brand (lineitem ⋈ part) and monthly
order value; demand model with a day spine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import forecast as fc
from ledgerline.operators import ml
from ledgerline.plans.registry import register
from ledgerline.session import reliable_checkpoint
from ledgerline.sources.tables import table


def monthly_orders(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("series"), F.date_trunc("month", "o_orderdate").alias("t")) \
            .agg(F.sum("o_totalprice").alias("y"))


@register("trend_models")
def q_trend_models(spark, d):
    f = fc.fit_models(monthly_orders(spark, d), "series", "t", "y", horizon=12)
    return f.filter(F.col("kind") == "fit").select("series", "model", "params", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")],
                                                   "stationary", "seasonal")


@register("trend_forecast")
def q_trend_forecast(spark, d):
    f = fc.fit_models(monthly_orders(spark, d), "series", "t", "y", horizon=12)
    return f.filter(F.col("kind") == "forecast").select("series", "model", "step", F.round("forecast", 2).alias("forecast"))


@register("trend_select")
def q_trend_select(spark, d):
    f = reliable_checkpoint(fc.fit_models(monthly_orders(spark, d), "series", "t", "y", horizon=12))
    return fc.select_best(f).withColumn("best_mae", F.round("best_mae", 4))


# ---------------------------------------------------------------- demand

def daily_demand(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    g = j.groupBy("p_brand", F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("label"),
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("price"))
    return fc.demand_features(g, "date")


DEMAND_NUM = ["price", "day_of_week", "month", "day", "quarter", "is_weekend", "is_month_start", "is_month_end",
              "weather_code", "holiday"]


def demand_model(spark, d):
    df = reliable_checkpoint(daily_demand(spark, d).withColumn("row", F.concat_ws("|", "p_brand", "date")))
    return ml.fit_forest(df, DEMAND_NUM, ["p_brand"], "row"), df


@register("demand_train")
def q_demand_train(spark, d):
    df = reliable_checkpoint(daily_demand(spark, d).withColumn("row", F.concat_ws("|", "p_brand", "date"))
                             .withColumn("_b", F.pmod(F.xxhash64("p_brand", "date"), F.lit(5))))
    train, test = df.filter("_b <> 0"), df.filter("_b = 0")
    t, _ = ml.train_regressors(train, test, DEMAND_NUM, ["p_brand"], "row")
    return t.select("model", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")], "selected")


@register("demand_predict")
def q_demand_predict(spark, d):
    model, df = demand_model(spark, d)
    p = fc.tree_interval(model, df)
    return p.select("p_brand", "date", F.round("prediction", 3).alias("prediction"),
                    F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper"))


@register("demand_forecast")
def q_demand_forecast(spark, d):
    model, df = demand_model(spark, d)
    last = df.groupBy("p_brand").agg(F.max("date").alias("_last"), F.avg("price").alias("price"))
    spine = fc.forecast_spine(last, "p_brand", "_last", 30).join(last.select("p_brand", "price"), "p_brand")
    p = model.transform(fc.demand_features(spine, "date"))
    roll = p.groupBy("p_brand").agg(F.round(F.sum("prediction"), 3).alias("total"), F.round(F.avg("prediction"), 3).alias("mean"),
                                    F.max_by("date", "prediction").alias("peak_day"), F.round(F.max("prediction"), 3).alias("peak_value"))
    return roll
