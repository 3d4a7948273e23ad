"""Registry of named analyses bound to the parquet tables.

Each entry is a callable ``(spark, base_dir) -> DataFrame`` and, where the
result is expressible in SQL, an equivalent DuckDB statement over views named
like the tables.  Both sides alias every computed column identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []
# analyses timed by bench.py (one per domain, the heaviest plan shapes)
BENCH_SET = ["rfm_segments", "basket_itemsets", "basket_rules", "price_strategy", "eoq_reorder",
             "delay_prediction", "route_distance", "sentiment_analyze", "cv_similarity", "quantile_agg",
             "roc_auc", "rate_window", "gap_rows", "profile_columns", "anomaly_dbscan", "stream_rate_window"]


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all():
    # import for side effect: each module registers its analyses
    from ledgerline.plans import (  # noqa: F401
        q_basket,
        q_extra,
        q_forecast,
        q_general,
        q_inventory,
        q_io,
        q_metrics,
        q_more,
        q_ml,
        q_pricing,
        q_rfm,
        q_streaming,
        q_supply,
        q_text,
    )
    return QUERIES, ORACLES
