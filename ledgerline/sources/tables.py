"""Access to the parquet tables an analysis runs over."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Lazily scan ``<base_dir>/<name>.parquet``.

    Column pruning and filter pushdown happen at this scan because callers only
    ever select/filter on the returned DataFrame.
    """
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, base_dir: str, names=TABLE_NAMES) -> None:
    for name in names:
        path = os.path.join(base_dir, f"{name}.parquet")
        if os.path.exists(path):
            table(spark, base_dir, name).createOrReplaceTempView(name)
