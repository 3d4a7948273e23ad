"""Quality rules: in-text base rules and cross-document line frequency.

A line is normalised (ASCII lower case, words joined by one blank) and
hashed.  Per host, the *distinct* texts holding a line are counted, so copies
of a document do not make its lines frequent.  A line found in more than
``min_docs`` texts and more than ``max_share`` of the host's texts is removed;
a document left with too few words is rejected.

Defined cases: a null text counts as empty (no words, base rules fail); a
null host is the host ''; repeated rows get the same verdict; an empty table
gives an empty result; extra columns pass through, own columns are under the
single struct ``_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import as_bytes, small_side, xxh64_signed
from ledgerline.session import reliable_checkpoint

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BROADCAST_LINES = 1_000_000  # longs: 8 MB


def line_hash(line: bytes) -> int | None:
    """Hash of a normalised line; None if it has no word."""
    words = line.lower().split()
    return xxh64_signed(b" ".join(words)) if words else None


def repeat_words(words: list[bytes]) -> int:
    """Words inside ``WINDOW``-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    size, key, span = len(seen), ids[:n], len(seen)
    for j in range(1, WINDOW):
        if span > (1 << 62) // size:  # number the prefixes anew so that keys stay exact
            key = np.unique(key, return_inverse=True)[1]
            span = n
        key = key * size + ids[j:j + n]
        span *= size
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inv, counts = np.unique(key, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[inv] > 1)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _sketch(texts: pa.Array) -> pa.Array:
    keys, rows = [], []
    for raw in as_bytes(texts):
        raw = raw or b""
        keys.append(xxhash.xxh3_128_digest(raw))
        rows.append(list({h for line in set(raw.split(b"\n")) if (h := line_hash(line)) is not None}))
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                                      names=["key", "lines"])


_SKETCH = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("lines", T.ArrayType(T.LongType()))])


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                   min_docs: int = 10, max_share: float = 0.10) -> DataFrame:
    """``host``, ``frequent`` (line hashes above the limits), ``n_frequent``.

    A host's frequent lines number at most its mean lines a text divided by
    ``max_share``, so each row is bounded.
    """
    sketch = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                         F.arrow_udf(_sketch, _SKETCH)(F.col(text_col).cast("string")).alias("s"))
    texts = reliable_checkpoint(
        sketch.groupBy("host", F.col("s.key").alias("key")).agg(F.first("s.lines").alias("lines"))
              .select("host", "lines"))
    totals = small_side(texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_texts")), 200_000)
    counts = (texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
                   .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs))
    return (counts.join(totals, "host").where(F.col("n") > max_share * F.col("n_texts"))
                  .groupBy("host").agg(F.collect_list("line").alias("frequent"))
                  .withColumn("n_frequent", F.size("frequent")))


_VERDICT = T.StructType([T.StructField(n, T.LongType()) for n in
                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "n_removed_lines", "n_removed_words")]
                        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
                           T.StructField("text", T.StringType())])


def judge(docs: DataFrame, frequent: DataFrame, host_col: str = "source", text_col: str = "text",
          max_removed: float = 0.7, with_text: bool = False) -> DataFrame:
    """``docs`` with ``_quality``: base counts, verdict and (``with_text``)
    the text without its frequent lines."""
    def run(texts: pa.Array, hosts_lines: pa.Array) -> pa.Array:
        out = {f.name: [] for f in _VERDICT}
        for raw, often in zip(as_bytes(texts), hosts_lines.to_pylist()):
            raw = raw or b""
            words, lines = raw.split(), raw.split(b"\n")
            filled = [x for x in lines if x.strip()]
            n, rep = len(words), repeat_words(words)
            removed = gone = 0
            rest = lines
            if often:
                often = set(often)
                rest = []
                for x in lines:
                    if line_hash(x) in often:
                        removed += 1
                        gone += len(x.split())
                    else:
                        rest.append(x)
            failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
            depleted = removed > 0 and (n - gone < MIN_WORDS or gone > max_removed * n)
            row = (n, len(raw.translate(None, SPACES).decode()), len(raw) - len(raw.translate(None, SYMBOLS)),
                   len(filled) - len(set(filled)), rep, removed, gone, failed, not failed and not depleted,
                   b"\n".join(rest).decode() if with_text else None)
            for name, value in zip(out, row):
                out[name].append(value)
        return pa.StructArray.from_arrays(
            [pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.string() if k == "text" else pa.int64())
             for k, v in out.items()], names=list(out))

    # marked so that a filter on the verdict does not run the function a second time
    verdict = F.arrow_udf(run, _VERDICT).asNondeterministic()
    host = "_ll4_host"
    side = small_side(frequent.select(F.col("host").alias(host), F.col("frequent").alias("_ll4_lines"),
                                      F.col("n_frequent").alias("_ll4_n")), BROADCAST_LINES, "_ll4_n")
    return (docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit("")))
                .join(side, host, "left")
                .withColumn("_quality", verdict(F.col(text_col).cast("string"), F.col("_ll4_lines")))
                .drop(host, "_ll4_lines", "_ll4_n"))


def line_frequency_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = 10,
                         max_share: float = 0.10, max_removed: float = 0.7, with_text: bool = False) -> DataFrame:
    """Both steps over ``docs``; see the module docstring."""
    often = frequent_lines(docs, host_col, text_col, min_docs, max_share)
    return judge(docs, often, host_col, text_col, max_removed, with_text)
