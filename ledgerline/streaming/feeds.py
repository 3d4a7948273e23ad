"""Structured Streaming forms of the stream-shaped analyses.

Each runs ``readStream`` over a folder of parquet files (new files are new
input), applies exactly the batch operator's expressions, and writes with
an ``availableNow`` trigger so the query drains what is there and stops.
Checkpoint and output live under the shared ``spark.checkpoint.dir``
folder, so a restarted query resumes exactly once from its offsets.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import text as TX
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.streaming.rate import rate_counts, rate_stream

FILES_A_CORE = 4


def _dirs(spark: SparkSession, name: str):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex}"
    return base + "/out", base + "/_checkpoint"


def source(spark: SparkSession, folder: str, table_name: str, max_files: int | None = None) -> DataFrame:
    """Streaming scan of ``<folder>/<table_name>.parquet``, one file or a
    folder of files (schema from the batch footer; streaming sources need an
    explicit schema).  A batch takes ``max_files`` files, by default
    ``FILES_A_CORE`` for every core, so that all of them have work."""
    path = os.path.join(folder, f"{table_name}.parquet")
    max_files = max_files or FILES_A_CORE * spark.sparkContext.defaultParallelism
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table_name}.parquet").parquet(folder)


def _drain(query, timeout_s: float | None) -> None:
    """Wait until the query has read all input.  With a limit, a query that
    is not done in time is stopped and reported: its output is a part only."""
    if query.awaitTermination(timeout_s) is False:
        query.stop()
        raise TimeoutError(f"stream not drained within {timeout_s} s")


def run_append(df: DataFrame, name: str, timeout_s: float | None = None) -> DataFrame:
    spark = df.sparkSession
    out, ckpt = _dirs(spark, name)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    _drain(q, timeout_s)
    return spark.read.parquet(out)


def run_complete(df: DataFrame, name: str, timeout_s: float | None = None) -> DataFrame:
    """Aggregations in complete mode: every micro-batch rewrites the whole
    result table (``foreachBatch`` overwrite), idempotent on retry."""
    spark = df.sparkSession
    out, ckpt = _dirs(spark, name)

    def write(batch: DataFrame, _epoch: int):
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
         .outputMode("complete").trigger(availableNow=True).start())
    _drain(q, timeout_s)
    return spark.read.parquet(out)


def stream_sentiment(spark: SparkSession, folder: str, table_name: str = "documents", id_col: str = "doc_id",
                     text_col: str = "text", text_expr=None) -> DataFrame:
    """Score a text feed with the row-wise form of the batch scorer (same
    numbers); ``text_expr`` replaces the text column if given."""
    s = source(spark, folder, table_name).select(id_col, text_col)
    if text_expr is not None:
        s = s.withColumn(text_col, text_expr)
    # row-wise fold: no stateful aggregation in the stream
    scored = TX.sentiment_scores_rowwise(s, text_col).drop(text_col)
    return run_append(scored, "sentiment")


def stream_rate(spark: SparkSession, folder: str, table_name: str = "events", ts_col: str = "ts",
                client_col: str = "user_id", window: str = "1 minute", limit: int = 100) -> DataFrame:
    s = source(spark, folder, table_name).select(ts_col, client_col)
    return run_complete(rate_counts(s, ts_col, client_col, window, limit), "rate")


def stream_rate_watermarked(spark: SparkSession, folder: str, table_name: str = "events", ts_col: str = "ts",
                            client_col: str = "user_id", window: str = "1 minute", limit: int = 100,
                            watermark: str = "10 minutes") -> DataFrame:
    """Append mode with a watermark: a window is emitted once the watermark
    passes its end, and its state is dropped (bounded state).  One file a
    batch, as the watermark moves between batches."""
    s = source(spark, folder, table_name, 1).select(ts_col, client_col)
    return run_append(rate_stream(s, ts_col, client_col, window, limit, watermark), "rate_wm")


def stream_scores(spark: SparkSession, folder: str, table_name: str, key_col: str, score_expr,
                  flag_expr) -> DataFrame:
    """Score new rows with a model fitted by a batch job (its parameters are
    literals inside ``score_expr``)."""
    s = source(spark, folder, table_name)
    return run_append(s.select(key_col, score_expr.alias("anomaly_score"), flag_expr.alias("is_anomaly")), "anomaly")
