"""Fixed-window request counting per client, batch and streaming.

The same ``rate_counts`` expression runs on a static DataFrame and on a
``readStream`` DataFrame; the streaming form adds a watermark so window
state is dropped once a window can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_counts(events: DataFrame, ts_col: str, client_col: str, window: str = "1 minute",
                limit: int = 100) -> DataFrame:
    """client, window_start, requests, breach (requests > limit)."""
    g = events.groupBy(F.window(ts_col, window).alias("w"), F.col(client_col)).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(client_col, F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") > limit).alias("breach"))


def rate_stream(stream: DataFrame, ts_col: str, client_col: str, window: str = "1 minute", limit: int = 100,
                watermark: str = "10 minutes") -> DataFrame:
    """Streaming form: watermark on event time, append-mode windows."""
    # watermarks need TIMESTAMP; with the UTC session the cast keeps the wall clock
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return rate_counts(s.withWatermark(ts_col, watermark), ts_col, client_col, window, limit)
