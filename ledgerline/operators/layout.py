"""Positioned words → table rows → cleaned cells (the table-recovery logic
that follows OCR; the OCR engines themselves are not part of this library).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint


def gap_rows(boxes: DataFrame, doc: str, x: str, y: str, text: str, gap: float = 10.0) -> DataFrame:
    """Gaps and islands: sort a document's words by (y, x), start a new row
    when the y-gap to the previous word exceeds ``gap``; inside a row order
    by x.  Lag and row number come from one segmented scan, so one huge document is
    still spread over many tasks; only a single row's words are collected, where
    the scan finds them."""
    def far(now, before):
        distance = pc.abs(pc.subtract(pc.cast(now[y], pa.float64()), pc.cast(before[y], pa.float64())))
        return pc.fill_null(pc.greater(distance, gap), False).to_numpy(zero_copy_only=False)

    b = stats.collected_runs(boxes.select(doc, x, y, text), doc, [y, x], y, [x, text], far, run_col="row_id")
    return b.select(doc, "row_id", F.transform(F.array_sort("words"), lambda s: s[text]).alias("cells"))


def split_columns(line) -> F.Column:
    """Cells of a text line separated by runs of two or more spaces."""
    c = F.col(line) if isinstance(line, str) else line
    return F.filter(F.transform(F.split(c, "  +"), lambda s: F.trim(s)), lambda s: s != "")


def best_tables(candidates: list[tuple[str, DataFrame]], doc: str) -> DataFrame:
    """(``doc``, ``method``, ``n_rows``, ``n_cells``, ``header``, ``row_id``, ``cells``): the rows below the
    header of the best table of every document, merged with their source.

    ``candidates`` are (method, rows (``doc``, ``row_id``, ``cells``)).  The one with most cells
    and more than one row wins, the first listed among equals; a document without
    such a candidate has no table.  Its cells are cleaned, empty rows go, the first
    row left is the header.  Counts and headers meet the rows by a join on the document,
    so no task holds a whole document."""
    rows = None
    for i, (method, own) in enumerate(candidates):
        own = own.select(doc, F.lit(i).alias("_order"), F.lit(method).alias("method"), F.col("row_id").cast("long").alias("row_id"),
                         F.size("cells").alias("_raw"), clean_cells("cells").alias("cells"))
        rows = own if rows is None else rows.unionByName(own)
    rows = reliable_checkpoint(rows)  # read for the counts and for the rows of the winner
    filled = F.size("cells") > 0
    each = rows.groupBy(doc, "_order").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_raw").alias("_cells"), F.count_if(filled).alias("n_rows"),
        F.sum(F.size("cells")).cast("long").alias("n_cells"), F.min(F.when(filled, F.struct("row_id", "cells"))).alias("_head"))
    won = F.max_by(F.struct("_order", "n_rows", "n_cells", "_head"), F.struct(F.col("_cells"), -F.col("_order"))).alias("_best")
    best = each.filter(F.col("_rows") > 1).groupBy(F.col(doc).alias("_doc")).agg(won).select("_doc", "_best.*").withColumnRenamed("_order", "_won")
    met = rows.filter(filled).join(best, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_order") == F.col("_won")) & (F.col("row_id") > F.col("_head.row_id")))
    return met.select(doc, "method", "n_rows", "n_cells", F.col("_head.cells").alias("header"), "row_id", "cells")


def record(header, cells) -> F.Column:
    """The cells of a row under the names of the header (``Column i`` beyond it), as an array of ``name: cell``."""
    h, c = (F.col(x) if isinstance(x, str) else x for x in (header, cells))
    name = lambda i: F.coalesce(F.get(h, i), F.concat(F.lit("Column "), (i + 1).cast("string")))
    return F.transform(c, lambda x, i: F.concat(name(i), F.lit(": "), x))


def clean_cells(cells) -> F.Column:
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.filter(F.transform(c, lambda s: F.trim(s)), lambda s: s != "")


def sheet_name(col) -> F.Column:
    """First 31 characters of the base name with []:*?/\\ removed."""
    c = F.col(col) if isinstance(col, str) else col
    base = F.regexp_replace(c, r"\.[^.]*$", "")
    return F.substring(F.translate(base, "[]:*?/\\", ""), 1, 31)
