"""Shared helpers of the llm operators."""

from __future__ import annotations

from contextlib import contextmanager

import xxhash
from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import ensure_checkpoint_dir, ship_package

WORD_SPACE = b" \t\n\r\x0b\x0c"  # bytes.split() without arguments splits on exactly these


BATCH_ROWS, BATCH_BYTES = 512, 8 << 20  # of an Arrow batch: texts of 100 kB and more occur


def prepare(spark: SparkSession) -> None:
    """Shared folder, worker code and Arrow batches that fit small executors;
    needed before any operator runs."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(values):
    """UTF-8 bytes (or None) of every string of an Arrow array."""
    import pyarrow as pa

    return values.cast(pa.large_binary()).to_pylist()


def xxh64_signed(data: bytes, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def small_side(df: DataFrame, max_rows: int, weight: str | None = None) -> DataFrame:
    """``df`` written once, with a broadcast hint only if its measured size
    (rows, or the sum of ``weight``) is at most ``max_rows``; a larger one is
    left to a shuffled join, where AQE splits hot keys."""
    from pyspark.sql import functions as F

    from ledgerline.session import reliable_checkpoint

    df = reliable_checkpoint(df)
    size = df.agg(F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_rows else df
