"""Cleaning, imputation and row alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import stats


def impute_values(df: DataFrame, col: str, key_col: str) -> DataFrame:
    """One-row table: mean, median (exact, linear) and mode (most frequent,
    ties → smallest value) of ``col``."""
    mean = df.agg(F.avg(col).alias("mean"))
    median = stats.exact_quantiles(df, col, key_col, [0.5], name="_m").select(F.col("_m")[0].alias("median"))
    mode = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")) \
        .agg(F.min_by(col, F.struct(-F.col("_c"), F.col(col))).alias("mode"))
    return mean.crossJoin(median).crossJoin(mode)


def impute(df: DataFrame, col: str, key_col: str, strategy: str = "mean", out: str | None = None) -> DataFrame:
    """Fill nulls of ``col`` by mean / median / mode (a one-row value joined
    to every row, no collect)."""
    if strategy == "mean":
        v = df.agg(F.avg(col).alias("_fill"))
    elif strategy == "median":
        v = stats.exact_quantiles(df, col, key_col, [0.5], name="_m").select(F.col("_m")[0].alias("_fill"))
    else:
        v = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")) \
              .agg(F.min_by(col, F.struct(-F.col("_c"), F.col(col))).alias("_fill"))
    return df.crossJoin(v).withColumn(out or col, F.coalesce(F.col(col), F.col("_fill").cast(df.schema[col].dataType))) \
             .drop("_fill")


def fill_unknown(df: DataFrame, cols, value: str = "Unknown") -> DataFrame:
    return df.fillna({c: value for c in cols})


def drop_key_nulls(df: DataFrame, keys) -> DataFrame:
    return df.dropna(subset=list(keys))


def align_features(df: DataFrame, features: dict) -> DataFrame:
    """Keep the model's features in order; add missing ones with their typed
    default (features = {name: default})."""
    cols = []
    for name, default in features.items():
        cols.append(F.col(name) if name in df.columns else F.lit(default).alias(name))
    return df.select(*cols)


def binary_label(col, positive="Yes"):
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.cast("string") == positive, 1).otherwise(0)


def null_to_blank(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def union_with_source(tables: dict) -> DataFrame:
    """Merge result tables with a leading Source column (by name)."""
    out = None
    for name, df in tables.items():
        x = df.select(F.lit(name).alias("Source"), *df.columns)
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
