"""Order statistics and evaluation metrics as distributed DataFrame plans.

Global ranks are never computed with an un-partitioned window (that moves
every row into one task).  ``with_global_row_number`` range-partitions on the
order key (the key always ends in a unique column, so a hot value is split
across partitions), numbers rows inside each partition, and adds the row
counts of all earlier partitions.  The offset table has one row per
partition, so broadcasting it is bounded by the partition count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.session import reliable_checkpoint, shuffle_partitions

_PID = "_ll_pid"
_IDX = "_ll_idx"
_OFF = "_ll_off"


def _cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_global_row_number(df: DataFrame, order_cols, name: str = "rn",
                           num_partitions: int | None = None,
                           total_name: str | None = None) -> DataFrame:
    """1-based row number over the total order ``order_cols`` (ascending,
    nulls first).  ``order_cols`` must end in a unique key so the order is
    total.  With ``total_name`` the row count is added as a column as well.

    The partition index and the position inside the sorted partition are
    recorded by the same task and materialised in the checkpoint folder, so
    the offset table and the numbering read identical values (two separate
    evaluations of a range exchange may sample different split points).
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    order = _cols(order_cols)
    ranged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn(_PID, F.spark_partition_id()))
    # monotonically_increasing_id = (partition index << 33) + position in the
    # sorted partition, so subtracting the partition part leaves the position.
    ranged = ranged.withColumn(
        _IDX, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
    ranged = reliable_checkpoint(ranged)
    sizes = ranged.groupBy(_PID).agg((F.max(_IDX) + 1).alias("_ll_cnt"))
    all_rows = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        _PID,
        F.coalesce(F.sum("_ll_cnt").over(
            Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias(_OFF),
        F.sum("_ll_cnt").over(all_rows).alias("_ll_total"))
    # offsets has one row per partition: a bounded broadcast
    out = (ranged.join(F.broadcast(offsets), _PID)
                 .withColumn(name, F.col(_OFF) + F.col(_IDX) + 1))
    if total_name:
        out = out.withColumnRenamed("_ll_total", total_name)
    return out.drop(_PID, _IDX, _OFF, "_ll_total")


SELECT_BUCKETS = 1024


def select_ranks(vals: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values at the given 0-based ranks of the finite doubles in ``col``, by
    refined histograms: a round counts the values of every open interval in
    ``SELECT_BUCKETS`` buckets and keeps, for each rank, the bucket that holds it
    with its least and greatest value, until those are one value.  No sort;
    a round moves at most ``SELECT_BUCKETS`` rows a rank and task."""
    low, high = vals.agg(F.min(col), F.max(col)).first()
    found: dict[int, float] = {}
    open_ = [(low, high, 0, sorted(set(ranks)))]  # least, greatest, values below, ranks
    while open_:
        for lo, _, _, own in (o for o in open_ if o[0] == o[1]):
            found.update({r: lo for r in own})
        open_ = [o for o in open_ if o[0] != o[1]]
        if not open_:
            break
        which, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        v = F.col(col)
        for i, (lo, hi, _, _) in enumerate(open_):
            inside = (v >= lo) & (v <= hi)
            place = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * SELECT_BUCKETS).cast("int")  # halves: the range may pass the largest double
            which = F.when(inside, i).otherwise(which)
            bucket = F.when(inside, F.least(place, F.lit(SELECT_BUCKETS - 1))).otherwise(bucket)
        rows = (vals.select(which.alias("i"), bucket.alias("b"), v.alias("v")).where(F.col("i").isNotNull())
                    .groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        fresh = []
        for i, (_, _, below, own) in enumerate(open_):
            for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["b"]):
                inner = [k for k in own if below <= k < below + r["n"]]
                if inner:
                    fresh.append((r["lo"], r["hi"], below, inner))
                below += r["n"]
        open_ = fresh
    return found


def exact_quantiles(df: DataFrame, value_col: str, key_col: str, probs,
                    name: str = "edges") -> DataFrame:
    """One-row DataFrame with ``name`` = array of exact quantiles (linear
    interpolation between closest ranks, as numpy/pandas/DuckDB
    ``quantile_cont``) and ``n`` = number of non-null values.  Infinite values and
    NaN (above all others) count as values.  By :func:`select_ranks` over the
    column, written once; ``key_col`` is not needed any more."""
    vals = reliable_checkpoint(df.select(F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    edges, n = quantile_values(vals, "_v", probs)
    return df.sparkSession.createDataFrame([(edges, n)], f"{name} array<double>, n long")


def quantile_values(table: DataFrame, col: str, probs) -> tuple[list[float] | None, int]:
    """Exact quantiles (None without values) and the count of the non-null doubles in
    ``col`` of a written ``table``, by :func:`select_ranks`."""
    vals = table.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    inf = float("inf")
    n, negative, finite, positive = vals.agg(
        F.count(F.lit(1)), F.count_if(F.col("_v") == -inf), F.count_if(~F.isnan("_v") & (F.abs("_v") != inf)), F.count_if(F.col("_v") == inf)).first()
    if not n:
        return None, 0
    at = [float(p) * (n - 1) for p in probs]
    places = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    inner = [k - negative for k in places if negative <= k < negative + finite]
    values = select_ranks(vals.filter(~F.isnan("_v") & (F.abs("_v") != inf)), "_v", inner) if inner else {}

    def value(k):
        if k < negative:
            return -inf
        if k < negative + finite:
            return values[k - negative]
        return inf if k < negative + finite + positive else float("nan")

    edges = []
    for x in at:
        lo, hi, part = value(math.floor(x)), value(math.ceil(x)), x - math.floor(x)
        edges.append(lo if part == 0 or lo == hi else lo + (hi - lo) * part)
    return edges, n


def qcut_edges_label(value: Column, edges: Column) -> Column:
    """0-based bin among distinct ``edges`` (right-closed, lowest included);
    null when fewer than two distinct edges."""
    return F.when(F.size(edges) < 2, F.lit(None).cast("int")).otherwise(
        F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < value)) - 1))


def qcut_raw(df: DataFrame, value_col: str, key_col: str, q: int = 4,
             out: str = "qcut_label") -> DataFrame:
    """0-based quantile bin of the raw value with duplicate edges dropped
    (right-closed bins, lowest edge included).  Null when fewer than two
    distinct edges remain.  The edge row is a single row (crossJoin of 1)."""
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(df, value_col, key_col, probs, name="_edges") \
        .select(F.array_distinct("_edges").alias("_edges"))
    return df.crossJoin(edges).withColumn(out, qcut_edges_label(F.col(value_col), F.col("_edges"))) \
             .drop("_edges")


def rank_bucket(rank: Column, n: Column, q: int) -> Column:
    """qcut(first-come rank, q) + 1 in integer arithmetic: ceil(q(r−1)/(n−1)),
    at least 1; 1 for a single row."""
    return F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor((F.lit(q) * (rank - 1) + n - 2) / (n - 1)))).cast("int")


def qcut_ranked(df: DataFrame, value_col: str, key_col: str, q: int = 4,
                out: str = "qcut_rank") -> DataFrame:
    """1-based quantile bin of the first-come rank (ties broken by
    ``key_col``); equals qcut(rank(method='first'), q) + 1, and 1 when there
    is a single row."""
    numbered = with_global_row_number(df, [F.col(value_col), F.col(key_col)], name="_rank",
                                      total_name="_n")
    return numbered.withColumn(out, rank_bucket(F.col("_rank"), F.col("_n"), q)).drop("_rank", "_n")


def share(df: DataFrame, value_col: str, out: str = "share_pct", by=None) -> DataFrame:
    """value / total × 100; ``by`` optional grouping.  The global total is a
    one-row aggregate joined back, not an un-partitioned window."""
    if by:
        by = [by] if isinstance(by, str) else list(by)
        tot = df.groupBy(*by).agg(F.sum(value_col).alias("_tot"))
        return df.join(tot, by).withColumn(out, F.col(value_col) / F.col("_tot") * 100).drop("_tot")
    tot = df.agg(F.sum(value_col).alias("_tot"))
    return df.crossJoin(tot).withColumn(out, F.col(value_col) / F.col("_tot") * 100).drop("_tot")


# ---------------------------------------------------------------- metrics

def confusion_counts(df: DataFrame, label: str, prediction: str, by=None) -> DataFrame:
    """tp/fp/tn/fn in one pass (partial aggregation map-side)."""
    by = [by] if isinstance(by, str) else list(by or [])
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"))


def classification_metrics(df: DataFrame, label: str, prediction: str, by=None,
                           zero_division: float = 0.0) -> DataFrame:
    """accuracy / precision / recall / F1 for the positive class 1, with an
    explicit value when a denominator is zero (1.0 in one reference flow,
    0.0 elsewhere)."""
    c = confusion_counts(df, label, prediction, by)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    zd = F.lit(float(zero_division))
    prec = F.when(tp + fp == 0, zd).otherwise(tp / (tp + fp))
    rec = F.when(tp + fn == 0, zd).otherwise(tp / (tp + fn))
    out = c.withColumn("accuracy", (tp + tn) / (tp + tn + fp + fn)) \
           .withColumn("precision", prec).withColumn("recall", rec)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, zd).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def roc_auc(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """Exact ROC AUC by the rank-sum (Mann–Whitney) formula with mid-ranks
    for tied scores.  Works on the per-score counts, so the global cumulative
    order runs over distinct scores only."""
    by = [by] if isinstance(by, str) else list(by or [])
    y = F.col(label).cast("int")
    per_score = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(y == 1).alias("_pos"))
    if by:
        w = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        ranked = per_score.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    else:
        numbered = with_global_row_number(per_score, ["_s"], name="_ord")
        ranked = _cumulative_before(numbered, "_ord", "_c", "_before")
    ranked = ranked.withColumn("_midrank", F.col("_before") + (F.col("_c") + 1) / 2.0)
    agg = ranked.groupBy(*by).agg(
        F.sum(F.col("_midrank") * F.col("_pos")).alias("_rs"),
        F.sum("_pos").alias("_P"), (F.sum("_c") - F.sum("_pos")).alias("_N"))
    P, N = F.col("_P"), F.col("_N")
    return agg.select(*by, F.when((P == 0) | (N == 0), F.lit(None).cast("double"))
                      .otherwise((F.col("_rs") - P * (P + 1) / 2.0) / (P * N)).alias("auc"),
                      P.alias("positives"), N.alias("negatives"))


def _cumulative_before(df: DataFrame, order_col: str, weight_col: str, out: str) -> DataFrame:
    """Sum of ``weight_col`` over all rows with a smaller ``order_col`` (a
    dense 1..n global number).  Range-partitioned running sums plus a
    per-partition offset table (bounded by the partition count)."""
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, order_col).withColumn(_PID, F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)
    part_tot = ranged.groupBy(_PID).agg(F.sum(weight_col).alias("_pt"))
    offsets = part_tot.select(_PID, F.coalesce(F.sum("_pt").over(
        Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(_OFF))
    w = Window.partitionBy(_PID).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offsets), _PID)
                  .withColumn(out, F.col(_OFF) + F.coalesce(F.sum(weight_col).over(w), F.lit(0)))
                  .drop(_PID, _OFF))


def regression_metrics(df: DataFrame, label: str, prediction: str, by=None) -> DataFrame:
    """RMSE, MAE and R² in one aggregation (R² = 1 − SSE/SST with SST =
    n · population variance, whose merge form keeps its digits for values far
    from zero)."""
    by = [by] if isinstance(by, str) else list(by or [])
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) ** 2).alias("_sse"),
        F.sum(F.abs(y - p)).alias("_sae"), F.var_pop(y).alias("_var"))
    n = F.col("n")
    sst = F.col("_var") * n
    return a.select(*by, "n", F.sqrt(F.col("_sse") / n).alias("rmse"),
                    (F.col("_sae") / n).alias("mae"),
                    F.when(sst == 0, F.lit(None).cast("double")).otherwise(1 - F.col("_sse") / sst).alias("r2"))


def acf(df: DataFrame, series_col: str, order_col: str, value_col: str, max_lag: int) -> DataFrame:
    """Autocorrelation per series for lags 1..max_lag:
    Σ (x_t − m)(x_{t−k} − m) / Σ (x_t − m)².  Lags are joins on the dense
    position, so every series is processed in parallel by key."""
    w = Window.partitionBy(series_col).orderBy(order_col)
    pos = df.select(series_col, F.row_number().over(w).alias("_t"), F.col(value_col).cast("double").alias("_x"))
    stats = pos.groupBy(series_col).agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    centred = pos.join(stats, series_col).withColumn("_d", F.col("_x") - F.col("_m"))
    denom = centred.groupBy(series_col).agg(F.sum(F.col("_d") * F.col("_d")).alias("_den"), F.first("_n").alias("n"))
    lags = df.sparkSession.range(1, max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    a = centred.select(series_col, "_t", "_d")
    b = centred.select(F.col(series_col).alias("_s2"), F.col("_t").alias("_t2"), F.col("_d").alias("_d2"))
    pairs = a.crossJoin(F.broadcast(lags)).join(
        b, (F.col(series_col) == F.col("_s2")) & (F.col("_t2") == F.col("_t") - F.col("lag")))
    num = pairs.groupBy(series_col, "lag").agg(F.sum(F.col("_d") * F.col("_d2")).alias("_num"))
    return num.join(denom, series_col).select(
        series_col, "lag", "n",
        F.when(F.col("_den") == 0, F.lit(None).cast("double")).otherwise(F.col("_num") / F.col("_den")).alias("acf"))


# ---------------------------------------------------------------- skew-safe keyed order ops

def top_n_per_key(df: DataFrame, keys, order_cols, n: int, salt_buckets: int = 64,
                  rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key under ``order_cols`` (which must
    make the order total).  Two rounds: first per (key, salt) so a hot key
    is spread over ``salt_buckets`` tasks, then per key over at most
    n × salt_buckets survivors.  A top-n report is the feature, so the
    limit is the result, not a shortcut."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = _cols(order_cols)
    salted = df.withColumn("_ll_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_ll_salt").orderBy(*order)
    pre = salted.withColumn("_ll_r1", F.row_number().over(w1)).filter(F.col("_ll_r1") <= n)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    out = pre.withColumn("_ll_r2", F.row_number().over(w2)).filter(F.col("_ll_r2") <= n)
    if rank_col:
        out = out.withColumnRenamed("_ll_r2", rank_col)
    return out.drop("_ll_salt", "_ll_r1", "_ll_r2")


def _scan_partition(keys: list[str], cols: list[str], prefix: str, breaks):
    """Lags and running counts of breaks inside one sorted partition; ``_ll_seg``
    numbers its keys from 0, ``_ll_pos`` its rows."""
    def changes(column, before):
        """True where a value differs from the one before it (two nulls are equal)."""
        both = pa.concat_arrays([before, column])
        x, y = both.slice(1), both.slice(0, len(column))
        differ = pc.fill_null(pc.not_equal(x, y), False)
        return np.asarray(pc.or_(differ, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False), bool)

    def run(batches):
        pid, last, pos, seg, count = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {name: batch.column(name) for name in {*keys, *cols}}
            before = {name: pa.nulls(1, x.type) if last is None else last[name] for name, x in columns.items()}
            fresh = np.zeros(n, bool)
            for k in keys:
                fresh |= changes(columns[k], before[k])
            fresh[0] &= last is not None  # the first row of a partition goes on with the key of the one before, if any
            shifted = {}
            for c in cols:
                moved = pa.concat_arrays([before[c], columns[c].slice(0, n - 1)])
                shifted[c] = pc.if_else(pa.array(fresh), pa.nulls(n, moved.type), moved)
            out = [*batch.columns, *[shifted[c] for c in cols]]
            own = seg + np.cumsum(fresh)
            if breaks is not None:
                step = np.asarray(breaks({c: columns[c] for c in cols}, shifted), np.int64)
                total = np.cumsum(step)
                starts = np.flatnonzero(fresh)
                base = np.full(n, -count)
                if len(starts):
                    at = np.searchsorted(starts, np.arange(n), "right") - 1
                    base = np.where(at >= 0, total[starts[np.maximum(at, 0)]] - step[starts[np.maximum(at, 0)]], base)
                    # a key's first row has no row before it: its own step counts as the function says
                running = total - base
                count = int(running[-1])
                out.append(pa.array(running))
            out += [pa.array(np.full(n, pid, np.int32)), pa.array(pos + np.arange(n)), pa.array(own)]
            names = [*batch.schema.names, *[prefix + c for c in cols], *([] if breaks is None else ["_ll_run"]), _PID, "_ll_pos", "_ll_seg"]
            yield pa.RecordBatch.from_arrays(out, names=names)
            last = {name: x.slice(n - 1, 1) for name, x in columns.items()}
            pos, seg = pos + n, int(own[-1])
    return run


def border_fixes(spark, ends, keys: list[str], cols: list[str], kinds: dict, breaks) -> DataFrame:
    """What every sorted partition takes over its border, from its first and last row
    (``ends``, in their order): the values before it and what adds to the count of its first key."""
    fixes, before, base = [], None, 0  # a row per partition
    for e in ends:
        goes_on = before is not None and all(e["first"][f"k{i}"] == before[f"k{i}"] for i in range(len(keys)))
        add = 0
        if goes_on:
            add = base + before["run"]
            if breaks is not None:
                kind = {c: to_arrow_type(kinds[c]) for c in cols}
                one = lambda r: {c: pa.array([r[f"c{i}"]], kind[c]) for i, c in enumerate(cols)}  # noqa: E731, B023
                add += int(np.asarray(breaks(one(e["first"]), one(before)))[0])
        fixes.append((e[_PID], *[before[f"c{i}"] if goes_on else None for i in range(len(cols))], add))
        base, before = add if e["last"]["seg"] == 0 else 0, e["last"]
    schema = T.StructType([T.StructField(_PID, T.IntegerType()), *[T.StructField(f"_ll_c{i}", kinds[c]) for i, c in enumerate(cols)],
                           T.StructField("_ll_add", T.LongType())])
    return spark.createDataFrame(fixes, schema)


def _pack_runs(scan, key: str, col: str, values: list[str]):
    """The scanned rows of a partition, one record a run: its key, the first and last ``col``,
    its ``values`` as a list and whether it touches a border of the partition."""
    def run(batches):
        held, number = None, 0  # the last run so far may go on

        def record(r, edge):
            words = pa.concat_arrays(r["words"])
            return pa.RecordBatch.from_arrays(
                [r[key], r["first"], r["last"], r["run"], r["pid"], r["seg"], pa.array([r["number"]], pa.int64()), pa.array([edge]),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=names)

        names = [key, "_ll_from", "_ll_to", "_ll_run", _PID, "_ll_seg", "_ll_pos", "_ll_edge", "_ll_words"]
        for batch in scan(batches):
            n, x = batch.num_rows, {name: batch.column(name) for name in batch.schema.names}
            words = pa.StructArray.from_arrays([x[v] for v in values], names=values)
            seg, count = (x[c].to_numpy() for c in ("_ll_seg", "_ll_run"))
            starts = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (count[1:] != count[:-1])))
            ends = np.append(starts[1:], n)
            if held is not None and held["seg"][0].as_py() == seg[0] and held["run"][0].as_py() == count[0]:
                held["words"].append(words.slice(0, ends[0]))
                held["last"] = x[col].slice(ends[0] - 1, 1)
                starts, ends = starts[1:], ends[1:]
            if not len(starts):
                continue
            if held is not None:
                yield record(held, held["number"] == 0)
            m = len(starts) - 1
            if m:
                at, to = pa.array(starts[:m]), pa.array(ends[:m] - 1)
                begin = int(starts[0])
                inner = words.slice(begin, int(ends[m - 1]) - begin)
                edge = np.zeros(m, bool)
                edge[0] = number == 0
                yield pa.RecordBatch.from_arrays(
                    [x[key].take(at), x[col].take(at), x[col].take(to), x["_ll_run"].take(at), x[_PID].take(at), x["_ll_seg"].take(at),
                     pa.array(number + np.arange(m)), pa.array(edge),
                     pa.ListArray.from_arrays(pa.array((np.append(starts[:m], ends[m - 1]) - begin).astype(np.int32)), inner)], names=names)
            own = slice(int(starts[m]), 1)
            held = {k: x[c].slice(own.start, 1) for k, c in ((key, key), ("first", col), ("run", "_ll_run"), ("pid", _PID), ("seg", "_ll_seg"))}
            held |= {"last": x[col].slice(n - 1, 1), "words": [words.slice(own.start, n - own.start)], "number": number + m}
            number += m + 1
        if held is not None:
            yield record(held, True)
    return run


def collected_runs(df: DataFrame, key: str, order_cols, col: str, values: list[str], breaks, run_col: str = "run") -> DataFrame:
    """(``key``, ``run_col``, ``words``): the ``values`` (structs, in no order) of every run of rows that
    ``breaks`` separates within a key; runs are counted as in :func:`segmented_scan`.

    The rows of a run lie side by side in the sorted partitions, so they are put
    together there and written as one record; only runs that touch a border of a
    partition are shuffled once more."""
    spark = df.sparkSession
    order = _cols([key, *order_cols])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    fields = [T.StructField(key, kinds[key]), T.StructField("_ll_from", kinds[col]), T.StructField("_ll_to", kinds[col]),
              T.StructField("_ll_run", T.LongType()), T.StructField(_PID, T.IntegerType()), T.StructField("_ll_seg", T.LongType()),
              T.StructField("_ll_pos", T.LongType()), T.StructField("_ll_edge", T.BooleanType()),
              T.StructField("_ll_words", T.ArrayType(T.StructType([T.StructField(v, kinds[v]) for v in values])))]
    scan = _scan_partition([key], [col], "prev_", breaks)
    x = reliable_checkpoint(ranged.mapInArrow(_pack_runs(scan, key, col, values), T.StructType(fields)))
    row = lambda c: F.struct(F.col(key).alias("k0"), F.col(c).alias("c0"), F.col("_ll_seg").alias("seg"), F.col("_ll_run").alias("run"))
    ends = x.groupBy(_PID).agg(F.min_by(row("_ll_from"), "_ll_pos").alias("first"), F.max_by(row("_ll_to"), "_ll_pos").alias("last")).orderBy(_PID).collect()
    fixed = x.join(F.broadcast(border_fixes(spark, ends, [key], [col], kinds, breaks)), _PID) \
             .withColumn(run_col, F.col("_ll_run") + F.when(F.col("_ll_seg") == 0, F.col("_ll_add")).otherwise(0))
    inner = fixed.where(~F.col("_ll_edge")).select(key, run_col, F.col("_ll_words").alias("words"))
    border = fixed.where("_ll_edge").groupBy(key, run_col).agg(F.flatten(F.collect_list("_ll_words")).alias("words"))
    return inner.unionByName(border)


def segmented_scan(df: DataFrame, keys, order_cols, cols, prefix: str = "prev_", breaks=None, run_col: str = "run") -> DataFrame:
    """Adds ``prev_<c>``, the value of ``c`` on the previous row of the same key (null
    on its first), and with ``breaks`` a running count within the key:
    ``breaks(current, previous)`` gets two dicts of Arrow arrays (``cols``) and gives
    0 or 1 a row (0 where there is no row before).

    One range exchange sorts by (keys, order), so a hot key spans many
    partitions; lags and counts run inside the sorted partitions in one pass,
    which is written once.  What goes over a border is one carry row a
    partition, combined in their order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    order = _cols([*keys, *order_cols])
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [*df.schema.fields, *[T.StructField(prefix + c, kinds[c]) for c in cols],
              *([] if breaks is None else [T.StructField("_ll_run", T.LongType())]),
              T.StructField(_PID, T.IntegerType()), T.StructField("_ll_pos", T.LongType()), T.StructField("_ll_seg", T.LongType())]
    x = reliable_checkpoint(ranged.mapInArrow(_scan_partition(keys, list(cols), prefix, breaks), T.StructType(fields)))
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)],
                   F.col("_ll_seg").alias("seg"), (F.lit(0) if breaks is None else F.col("_ll_run")).cast("long").alias("run"))
    ends = x.groupBy(_PID).agg(F.min_by(row, "_ll_pos").alias("first"), F.max_by(row, "_ll_pos").alias("last")).orderBy(_PID).collect()
    out = x.join(F.broadcast(border_fixes(spark, ends, keys, cols, kinds, breaks)), _PID)
    for i, c in enumerate(cols):
        out = out.withColumn(prefix + c, F.when(F.col("_ll_pos") == 0, F.col(f"_ll_c{i}")).otherwise(F.col(prefix + c)))
    if breaks is not None:
        out = out.withColumn(run_col, F.col("_ll_run") + F.when(F.col("_ll_seg") == 0, F.col("_ll_add")).otherwise(0)).drop("_ll_run")
    return out.drop(_PID, "_ll_pos", "_ll_seg", "_ll_add", *[f"_ll_c{i}" for i in range(len(cols))])


def with_previous(df: DataFrame, keys, order_cols, cols, prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<c>`` = value of ``c`` on the previous row of the same key
    (null on the first row): lag without a per-key window; see
    :func:`segmented_scan`."""
    return segmented_scan(df, keys, order_cols, cols, prefix)


def exact_group_quantiles(df: DataFrame, key: str, value_col: str, id_col: str, probs,
                          name: str = "quantiles") -> DataFrame:
    """Per key: array of exact quantiles (linear interpolation).  Rows are
    numbered over (key, value, id) with the range-partitioned global
    numbering, so a key holding a third of all rows is spread over many
    tasks; each key then needs only the ≤ 2·len(probs) rows at its
    positions.  No per-group value buffer is ever built."""
    vals = df.select(F.col(key).alias("_g"), F.col(value_col).cast("double").alias("_v"),
                     F.col(id_col).alias("_k")).filter(F.col("_v").isNotNull())
    numbered = with_global_row_number(vals, ["_g", "_v", "_k"], name="_rn")
    bounds = numbered.groupBy("_g").agg(F.min("_rn").alias("_start"), F.count(F.lit(1)).alias("_n"))
    pos = [F.col("_start") + F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    wanted = bounds.select("_g", "_start", "_n",
                           F.array(*[F.floor(p) for p in pos], *[F.ceil(p) for p in pos]).alias("_want"))
    picked = numbered.join(wanted, "_g").filter(F.array_contains("_want", F.col("_rn"))) \
        .groupBy("_g", "_start", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rn", "_v"))).alias("_m"))
    qs = []
    for p in probs:
        at = F.col("_start") + F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.element_at("_m", F.floor(at)), F.element_at("_m", F.ceil(at))
        qs.append(lo + (hi - lo) * (at - F.floor(at)))
    return picked.select(F.col("_g").alias(key), F.col("_n").alias("n"), F.array(*qs).alias(name))


def keyed_running_sum(df: DataFrame, keys, order_cols, weight_col: str, out: str) -> DataFrame:
    """Running sum of ``weight_col`` within each key in ``order_cols`` order
    (inclusive of the current row) without a per-key window: rows are
    numbered over (keys, order) globally, a global running sum is built from
    range-partitioned partial sums, and each key's total before its first row
    is subtracted (one row per key, joined on the key).  Floating weights are
    summed as DECIMAL with six places, so a large prefix costs no digits."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    kind = dict(df.dtypes)[weight_col]
    exact = F.col(weight_col).cast("decimal(28,6)") if kind in ("double", "float") else F.col(weight_col)
    numbered = with_global_row_number(df.withColumn("_ll_w", exact), [*keys, *order_cols], name="_ll_g")
    cum = _cumulative_before(numbered, "_ll_g", "_ll_w", "_ll_before").drop(_PID)
    base = cum.groupBy(*keys).agg(F.min_by("_ll_before", "_ll_g").alias("_ll_base"))
    total = F.col("_ll_before") - F.col("_ll_base") + F.col("_ll_w")
    return cum.join(base, keys).withColumn(out, total.cast(kind) if kind in ("double", "float") else total) \
              .drop("_ll_g", "_ll_before", "_ll_base", "_ll_w")
