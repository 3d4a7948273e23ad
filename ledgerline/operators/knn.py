"""Imputation from the nearest donors over several columns, exact.

The distance of two rows is taken over the columns that both have: the mean
squared difference over those, times the number of all columns (so rows with
few common columns are not nearer for it).  A missing value becomes the mean
of the ``k`` nearest rows that have the column; equal distances are ordered by
the key; with no row in common it becomes the mean of the column.

Donors of one missing pattern meet receivers over the columns that both have.
For every such pair of donor pattern and common columns (a family) the donors are
put into cells by quantile bins of those columns; the wider a column
spreads, the more bins it gets, so that a cell is about as wide in one column as
in another and few cells lie near a receiver.  Cells are described by a count
and a bounding box.  The boxes alone bound, for every receiver, the distance within
which ``k`` donors lie for certain; only cells that come nearer than that are
searched.  Receivers travel to those cells in groups of at most ``RECEIVERS``; of
donors equal in all columns of a family a cell keeps the ``k`` first, as no more can
count.  Nothing is sampled and no list of candidates is cut.  With more than
``PATTERNS`` patterns there is one family a donor pattern, binned by all its columns.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import reliable_checkpoint

CELLS = 2048  # most cells of a family
CELL_ROWS = 512  # donors a cell should have
PATTERNS = 32
RECEIVERS = 4096
PART = 1 << 21  # distances held at a time
DEAL_ROWS = 1 << 17  # donors among which equal ones are dropped before they are dealt


class Families:
    """The families that the patterns ``counts`` (pattern: rows) need, and the bins of each."""

    def __init__(self, counts: dict[int, int], quantiles: list[list[float]], width: int):
        self.width, self.full, self.few, self.size = width, (1 << width) - 1, len(counts) <= PATTERNS, CELLS
        found = {(q, self.columns(p, q)) for p, q in product(counts, counts) if p != self.full and q & ~p and p & q}
        self.all = sorted(found)
        self.number = {f: i for i, f in enumerate(self.all)}
        self.cuts = [self._cuts([i for i in range(width) if c >> i & 1], counts[q], quantiles) for q, c in self.all]

    def columns(self, receiver: int, donor: int) -> int:
        return receiver & donor if self.few else donor

    def _cuts(self, columns: list[int], rows: int, quantiles: list[list[float]]) -> dict[int, np.ndarray]:
        """Cut points of each column: the widest bins are halved until there are cells enough."""
        at = lambda i, n: np.unique(quantiles[i][len(quantiles[i]) // n::len(quantiles[i]) // n]) if quantiles[i] else np.zeros(0)
        spread = {i: (quantiles[i][-1 - len(quantiles[i]) // 20] - quantiles[i][len(quantiles[i]) // 20]) or quantiles[i][-1] - quantiles[i][0]
                  for i in columns if quantiles[i]}
        bins = dict.fromkeys(columns, 1)
        cells = 1
        while spread and 2 * cells <= min(self.size, rows // CELL_ROWS):
            i = max(spread, key=lambda i: spread[i] / bins[i])
            if 2 * bins[i] > len(quantiles[i]) or len(at(i, 2 * bins[i])) <= len(at(i, bins[i])):
                del spread[i]  # no more different cuts
                continue
            bins[i], cells = 2 * bins[i], 2 * cells
        return {i: at(i, n) if n > 1 else np.zeros(0) for i, n in bins.items()}

    def cells(self, family: int, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for i, cuts in self.cuts[family].items():
            out = out * (len(cuts) + 1) + np.searchsorted(cuts, rows[:, i], "left")
        return family * self.size + out


def _families(x: DataFrame, names: list[str]) -> Families:
    counts = {r.pattern: r["count"] for r in x.groupBy("pattern").count().collect()}  # a row a pattern
    n = 1 << max(CELLS.bit_length() - 1, 0)
    quantiles = x.agg(*[F.percentile_approx(c, [i / n for i in range(n)], 10000).alias(c) for c in names]).first()
    return Families({p: r for p, r in counts.items() if p}, [quantiles[c] or [] for c in names], len(names))


def _first_equal(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first, by their ids, of the rows that are equal."""
    order = np.lexsort((ids, *rows.T))
    fresh = np.concatenate([[True], (rows[order[1:]] != rows[order[:-1]]).any(axis=1)])
    begin = np.flatnonzero(fresh)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def _deal(families: Families, k: int):
    """(cell, id, values) rows of every donor, one for each of its families."""
    width = families.width

    def cells_of(t: pa.Table):
        ids, pattern = t["id"].to_numpy(), t["pattern"].to_numpy()
        rows = np.stack([t[f"x{i}"].to_numpy() for i in range(width)], axis=1).astype(float)
        for f, (q, columns) in enumerate(families.all):
            own = np.flatnonzero(pattern == q)
            if len(own):
                own = own[_first_equal(rows[np.ix_(own, [i for i in range(width) if columns >> i & 1])], ids[own], k)]
                here = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(families.cells(f, rows[own])), *[t[c].combine_chunks().take(here) for c in ("id", *[f"x{i}" for i in range(width)])]],
                    names=["cell", "id", *[f"x{i}" for i in range(width)]])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DEAL_ROWS:
                yield from cells_of(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from cells_of(pa.Table.from_batches(held))
    return run


def _box_distances(rows: np.ndarray, low: np.ndarray, high: np.ndarray, common: np.ndarray, width: int):
    """Least and greatest distance of each row to each box over the ``common`` columns."""
    near, far = np.zeros((len(rows), len(low))), np.zeros((len(rows), len(low)))
    for i in common:
        a, b = low[:, i] - rows[:, i, None], rows[:, i, None] - high[:, i]
        near += np.maximum(np.maximum(a, b), 0) ** 2
        far += np.maximum(np.abs(a), np.abs(b)) ** 2
    return near * width / len(common), far * width / len(common)


def _find_cells(cells: list[tuple], families: Families, k: int):
    """(receiver, column to fill, cell to search) rows."""
    width = families.width
    ids = np.array([c[0] for c in cells], np.int64)
    family, counts = ids // families.size, np.array([c[1] for c in cells], np.int64)
    low, high = (np.array([[np.nan if v is None else v for v in c[j:j + width]] for c in cells], float).reshape(-1, width) for j in (2, 2 + width))
    of = {f: np.flatnonzero(family == f) for f in np.unique(family).tolist()}
    patterns = sorted({q for q, _ in families.all})

    def run(batches):
        for batch in batches:
            pattern = batch.column(1).to_numpy()
            rows = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1).astype(float)
            for p, t in product(np.unique(pattern).tolist(), range(width)):
                if p >> t & 1:
                    continue
                common = {q: [i for i in range(width) if p >> i & q >> i & 1] for q in patterns if q >> t & 1}
                known = [(i, of[families.number[q, families.columns(p, q)]]) for q, i in common.items() if i]
                if not known:
                    continue
                mine = np.concatenate([c for _, c in known])
                large = counts[mine] >= k
                own = np.flatnonzero(pattern == p)
                for at in range(0, len(own), max(1, PART // len(mine))):
                    part = own[at:at + max(1, PART // len(mine))]
                    near, far = (np.concatenate(x, axis=1) for x in zip(*[_box_distances(rows[part], low[c], high[c], i, width) for i, c in known]))
                    if large.any():
                        bound = far[:, large].min(axis=1)
                    else:  # k donors in several cells
                        order = np.argsort(far, axis=1)
                        held = np.cumsum(counts[mine][order], axis=1)
                        enough = np.argmax(held >= k, axis=1)
                        bound = np.where(held[:, -1] >= k, far[np.arange(len(part)), order[np.arange(len(part)), enough]], np.inf)
                    r, c = np.nonzero(near <= bound[:, None] * (1 + 1e-9) + 1e-12)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(part[r])), pa.array(np.full(len(r), t, np.int32)), pa.array(ids[mine[c]]),
                         *[batch.column(2 + i).take(pa.array(part[r])) for i in range(width)]],
                        names=["id", "target", "cell", *[f"x{i}" for i in range(width)]])
    return run


def _nearest(families: Families, k: int):
    """The ``k`` nearest donors of one cell for each receiver sent to it."""
    width = families.width

    def run(receivers: pa.Table, donors: pa.Table) -> pa.Table:
        values = lambda t: np.stack([t[f"x{i}"].to_numpy() for i in range(width)], axis=1).astype(float)
        out = [[], [], [], [], []]
        if donors.num_rows and receivers.num_rows:
            columns = families.all[donors["cell"][0].as_py() // families.size][1]
            d, ids = values(donors), donors["id"].to_numpy()
            first = _first_equal(d[:, [i for i in range(width) if columns >> i & 1]], ids, k)
            first = first[np.argsort(ids[first], kind="stable")]  # in the order of their keys
            d, ids = d[first], ids[first]
            r, target, rid = values(receivers), receivers["target"].to_numpy(), receivers["id"].to_numpy()
            present = ~np.isnan(d[0])
            for at in range(0, len(r), max(1, PART // len(d))):
                part = slice(at, at + max(1, PART // len(d)))
                own = r[part]
                total, common = np.zeros((len(own), len(d))), np.zeros(len(own))
                for i in np.flatnonzero(present):
                    here = ~np.isnan(own[:, i])
                    if here.any():
                        apart = (own[:, i, None] - d[:, i]) ** 2
                        total += apart if here.all() else np.where(here[:, None], apart, 0)
                        common += here
                total = total * width / common[:, None]
                n = min(k, len(d))
                row, near = np.nonzero(total <= np.partition(total, n - 1, axis=1)[:, n - 1, None])  # more than n if the last are equally near
                apart = total[row, near]
                order = np.lexsort((near, apart, row))
                begin = np.searchsorted(row, np.arange(len(own)))
                keep = order[np.arange(len(row)) - begin[row] < n]
                row, near, apart = row[keep], near[keep], apart[keep]
                for j, x in enumerate((rid[part][row], target[part][row], apart, ids[near], d[near, target[part][row]])):
                    out[j].append(x)
        cat = lambda j, kind: pa.array(np.concatenate(out[j]) if out[j] else np.zeros(0), kind)
        return pa.table({"id": cat(0, pa.int64()), "target": cat(1, pa.int32()), "distance": cat(2, pa.float64()),
                         "donor": cat(3, pa.int64()), "value": cat(4, pa.float64())})
    return run


def impute_knn(df: DataFrame, cols: list[str], key: str, k: int = 5) -> DataFrame:
    """``df`` with the missing values (null or NaN) of the numeric ``cols`` filled; ``key`` is a unique whole number."""
    names = [f"x{i}" for i in range(len(cols))]
    x = df.select(F.col(key).cast("long").alias("id"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(cols, names)])
    pattern = sum((F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    x = reliable_checkpoint(x.withColumn("pattern", pattern))
    families = _families(x, names)
    fields = ", ".join(f"{n} double" for n in names)
    dealt = x.where("pattern > 0").mapInArrow(_deal(families, k), f"cell long, id long, {fields}")
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)), *[F.min(n) for n in names], *[F.max(n) for n in names])
    boxes = [tuple(r) for r in cells.collect()]  # at most CELLS a family
    wanted = reliable_checkpoint(x.where(F.col("pattern") < families.full).select("id", "pattern", *names)
                                  .mapInArrow(_find_cells(boxes, families, k), f"id long, target int, cell long, {fields}"))
    sizes = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / RECEIVERS).cast("int").alias("parts"))
    receivers = wanted.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", "target"), F.col("parts")).cast("int")).drop("parts")
    donors = dealt.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", *names)
    found = receivers.groupBy("cell", "part").cogroup(donors.groupBy("cell", "part")).applyInArrow(
        _nearest(families, k), "id long, target int, distance double, donor long, value double")
    best = found.groupBy("id", "target").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "donor", "value"))), 1, k).alias("near"))
    filled = best.select("id", "target", (F.aggregate("near", F.lit(0.0), lambda a, n: a + n["value"]) / F.size("near")).alias("value"))
    wide = filled.groupBy("id").agg(*[F.max(F.when(F.col("target") == i, F.col("value"))).alias(f"_f{i}") for i in range(len(cols))])
    means = x.agg(*[F.avg(n).alias(f"_m{i}") for i, n in enumerate(names)])
    out = df.withColumn("_id", F.col(key).cast("long")).join(wide.withColumnRenamed("id", "_id"), "_id", "left").crossJoin(means)  # one row
    for i, c in enumerate(cols):
        own = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        out = out.withColumn(c, F.coalesce(own, F.col(f"_f{i}"), F.col(f"_m{i}")))
    return out.select(*df.columns)
