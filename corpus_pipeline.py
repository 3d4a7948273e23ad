"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``; a stage that changes a text also
renews ``n_chars``.

Defined cases: null texts, ids and sources pass through every stage's operator
(see there; an empty text fails the quality rules, so it goes in the first
stage); an empty table gives an empty result; further columns are kept by all
stages, but for ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``covered_bytes``,
which the last stage's own columns replace.

1. quality_rules: rejected documents go; frequent lines leave the text.
2. simhash_near_dedup: one document of each component stays (smallest id).
3. decontamination: documents that hold a benchmark item go.
4. secret_scan: every secret span becomes ``[SECRET]``.
5. sentencepiece: adds n_tokens, ids_sha256, decoded_sha256, covered_bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, pieces, quality, secrets, simhash
from ledgerline.llm.common import prepare, table
from ledgerline.llm.queries import tokenizer_path
from ledgerline.session import ensure_checkpoint_dir, reliable_checkpoint


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``columns`` with a new text and, where the table has one, its length."""
    docs = docs.withColumn("text", text)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    judged = quality.line_frequency_rules(docs, with_text=True)
    kept = judged.where(F.col("_quality.kept"))
    return _with_text(kept, F.col("_quality.text"), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_items") == 0).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    scanned = reliable_checkpoint(secrets.scan(docs))  # read twice: for the limits and for the verdicts
    judged = secrets.judge(scanned, secrets.cut_offs(scanned))
    return _with_text(judged, secrets.redact(F.col("text"), F.col("_secrets.all")), docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")
    return pieces.digests(pieces.encode_decode(docs, tokenizer_path()), *[c for c in docs.columns if c not in new])


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup),
          ("decontamination", decontamination), ("secret_scan", secret_scan), ("sentencepiece", sentencepiece)]

ORACLE_SQL = None  # fingerprints, edit search and pieces have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
