"""Column profiling and role detection.  Every profile is one aggregation
pass producing one row, unpivoted into a column table (one row per input
column), so the driver only ever sees the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _type_name(dt) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "string"


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """column, position, data_type, rows, distinct_count, missing_count.

    One small aggregation per column: the scan reads that column alone, its
    values are counted by value first (combined before the shuffle, so a hot
    value is one row per task) and then summed.  Together the scans read the
    table once; no row is copied per column.  ``approx`` counts distinct
    values by sketch instead."""
    out = None
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if approx:
            one = df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(c).alias("distinct_count"),
                         F.count_if(c.isNull()).alias("missing_count"))
        else:
            one = df.groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("_v").alias("distinct_count"),
                F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("missing_count"))
        row = one.select(F.lit(f.name).alias("column"), F.lit(i).alias("position"),
                         F.lit(_type_name(f.dataType)).alias("data_type"), "rows", "distinct_count", "missing_count")
        out = row if out is None else out.unionByName(row)
    return out


def basket_flags(profile: DataFrame) -> DataFrame:
    """is_numeric, is_datetime, is_categorical (distinct ≤ 30),
    is_identifier (distinct > 0.8·rows or the name contains 'id')."""
    return profile.withColumns({
        "is_numeric": F.col("data_type").isin("integer", "float"),
        "is_datetime": F.col("data_type") == "datetime",
        "is_categorical": F.col("distinct_count") <= 30,
        "is_identifier": (F.col("distinct_count") > 0.8 * F.col("rows")) | F.lower("column").contains("id"),
    })


def pricing_roles(profile: DataFrame) -> DataFrame:
    """numeric → categorical if d < 10 and d/n < 0.05; string →
    categorical if d < 10 or d/n < 0.5 else text; price-like numeric names
    are target candidates; missing %."""
    d, n = F.col("distinct_count"), F.col("rows")
    num = F.col("data_type").isin("integer", "float")
    role = F.when(num & (d < 10) & (d / n < 0.05), "categorical").when(num, "numeric") \
            .when((d < 10) | (d / n < 0.5), "categorical").otherwise("text")
    name = F.lower("column")
    target = num & (name.contains("price") | name.contains("cost") | name.contains("value") | name.contains("amount"))
    return profile.withColumn("role", role).withColumn("possible_target", target) \
                  .withColumn("missing_pct", F.col("missing_count") / n * 100)


def data_quality(df: DataFrame) -> DataFrame:
    """completeness % = 1 − nulls/cells, unique rows, duplicate %."""
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("_nulls"))
    uniq = df.distinct().agg(F.count(F.lit(1)).alias("unique_rows"))
    cells = F.col("rows") * len(df.columns)
    return base.crossJoin(uniq).select(
        "rows", "unique_rows",
        ((1 - F.col("_nulls") / cells) * 100).alias("completeness_pct"),
        ((F.col("rows") - F.col("unique_rows")) / F.col("rows") * 100).alias("duplicate_pct"))


def describe(df: DataFrame, cols, key_col: str) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (exact, linear), max of each
    numeric column.  The columns are written once as doubles; one aggregation
    serves the moments of all, and the quantiles are selected column by column by
    refined histograms, without a sort; ``key_col`` is not needed any more."""
    x = reliable_checkpoint(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("v")) for i, c in enumerate(cols)])
    m = x.select(F.explode(cells).alias("x")).select("x.column", "x.v").groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = [(c, stats.quantile_values(x, f"c{i}", [0.25, 0.5, 0.75])[0]) for i, c in enumerate(cols)]
    q = df.sparkSession.createDataFrame(q, "column string, _q array<double>")  # one row a column
    return m.join(F.broadcast(q), "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p75"), "max")


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    return stats.share(counts, "count", out="pct")


def validate_binary_target(df: DataFrame, target: str) -> DataFrame:
    t = F.col(target)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~t.isin(0, 1) | t.isNull()).alias("invalid"),
                  F.min(t).alias("min_value"), F.max(t).alias("max_value")) \
             .withColumn("valid", (F.col("invalid") == 0) & (F.col("min_value") == 0) & (F.col("max_value") == 1))


# fixed values: names that usually hold the target, in order of preference
TARGET_KEYWORDS = ("leave", "churn", "attrition", "left", "stayed", "status", "turnover", "retention", "resigned",
                   "terminated", "active")


def detect_target_binary(profile: DataFrame, suggested=(), keywords=TARGET_KEYWORDS) -> DataFrame:
    """The target column: the first ``suggested`` column that has two values,
    or up to five and is not a float; else, keyword by keyword, the column of
    that name or the first whose name contains it; else the first column with
    two values; null if there is none."""
    p, name = F.col("position"), F.lower("column")
    small = (F.col("distinct_count") == 2) | ((F.col("distinct_count") <= 5) & (F.col("data_type") != "float"))
    rank = F.lit(None).cast("int")
    rank = F.when(F.col("distinct_count") == 2, 2 * len(keywords)).otherwise(rank)
    for i, k in reversed(list(enumerate(keywords))):
        rank = F.when(F.col("column") == k, 2 * i).when(name.contains(k), 2 * i + 1).otherwise(rank)
    for i, c in reversed(list(enumerate(suggested))):
        rank = F.when((F.col("column") == c) & small, i - len(suggested)).otherwise(rank)
    return profile.withColumn("_rank", rank).filter(F.col("_rank").isNotNull()) \
                  .agg(F.min_by("column", F.struct("_rank", p.alias("_p"))).alias("target"))
