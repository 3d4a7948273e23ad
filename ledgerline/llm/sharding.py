"""Best-fit-decreasing sharding of indivisible groups.

Rows with equal texts form a group that stays in one shard; only a group that
is larger than a whole shard is cut, into fragments of an eighth of a shard.
Groups sorted by size enter the shard with the tightest remaining capacity,
found in a balanced (AVL) tree.  The order is kept at every input size by two
levels: units of at least ``1 / (256 * shards)`` of all bytes - at most
``256 * shards`` exist, whatever the input - are packed first, in one place;
the many small ones are dealt by hash to cells of about ``CELL_UNITS`` units,
and each cell packs its own into its share of every shard's free space.

Defined cases: a null text has no bytes (size is the overhead) and forms one
group with the other null texts; empty texts form another; repeated rows are
rows of one group; an empty table gives an empty result; other columns are
not kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import small_side
from ledgerline.session import reliable_checkpoint, shuffle_partitions

CELL_UNITS = 20_000
BIG_PER_SHARD = 256
FRAGMENTS = 8


class Tree:
    """AVL tree of (free space, shard)."""

    __slots__ = ("root",)

    def __init__(self, items=()):
        self.root = None
        for x in items:
            self.add(x)

    @staticmethod
    def _fix(n):
        # a node is [key, left, right, height]
        def high(x):
            return x[3] if x else 0

        def grade(x):
            x[3] = 1 + max(high(x[1]), high(x[2]))
            return x

        def lift(x, up):
            y = x[up]
            x[up], y[3 - up] = y[3 - up], x
            grade(x)
            return grade(y)

        grade(n)
        lean = high(n[1]) - high(n[2])
        if abs(lean) < 2:
            return n
        up = 1 if lean > 0 else 2
        if high(n[up][3 - up]) > high(n[up][up]):
            n[up] = lift(n[up], 3 - up)
        return lift(n, up)

    def add(self, key):
        def go(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = go(n[side])
            return self._fix(n)
        self.root = go(self.root)

    def remove(self, key):
        def go(n, key):
            if key == n[0]:
                if n[1] is None or n[2] is None:
                    return n[1] or n[2]
                low = n[2]
                while low[1]:
                    low = low[1]
                n[0] = low[0]
                n[2] = go(n[2], low[0])
            else:
                side = 1 if key < n[0] else 2
                n[side] = go(n[side], key)
            return self._fix(n)
        self.root = go(self.root, key)

    def tightest(self, size):
        """Least key with free space of at least ``size``, or None."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        return best

    def widest(self):
        n = self.root
        while n[2]:
            n = n[2]
        return n[0]


def best_fit_decreasing(sizes: list[int], free: dict[int, float], strict: bool) -> list[int | None]:
    """Shard of each size (given in decreasing order).  What fits nowhere gets
    None if ``strict``, else the shard with the most free space."""
    tree = Tree((space, shard) for shard, space in free.items())
    out = []
    for size in sizes:
        spot = tree.tightest(size)
        if spot is None:
            if strict or tree.root is None:
                out.append(None)
                continue
            spot = tree.widest()
        tree.remove(spot)
        tree.add((spot[0] - size, spot[1]))
        out.append(spot[1])
    return out


def _pack(units: DataFrame, free: dict[int, float], total: int, strict: bool) -> DataFrame:
    """``units`` (key, frag, bytes) with ``shard``."""
    spark = units.sparkSession
    least = total / (BIG_PER_SHARD * len(free))
    # each is at least ``least`` of ``total`` bytes, so at most BIG_PER_SHARD rows a shard are fetched
    big = [(bytes(r.key), r.frag, r.bytes) for r in
           units.where(F.col("bytes") >= least).orderBy(F.col("bytes").desc(), "key", "frag").collect()]
    spots = best_fit_decreasing([r[2] for r in big], free, strict)
    for row, shard in zip(big, spots):
        if shard is not None:
            free[shard] -= row[2]
    small = units.where(F.col("bytes") < least)
    n, amount = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cells = max(1, -(-n // CELL_UNITS))

    def pack_cell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "key", "frag"], ascending=[False, True, True])
        share = float(frame["bytes"].sum()) / max(float(amount), 1.0)
        spots = best_fit_decreasing(frame["bytes"].tolist(), {s: f * share for s, f in free.items()}, strict)
        return frame[["key", "frag", "bytes"]].assign(shard=pd.array(spots, "Int32"))

    cell = F.pmod(F.xxhash64("key", "frag"), F.lit(cells))
    packed = small.withColumn("cell", cell).groupBy("cell").applyInPandas(
        pack_cell, "key binary, frag int, bytes long, shard int")
    fixed = spark.createDataFrame([(*r, s) for r, s in zip(big, spots)], "key binary, frag int, bytes long, shard int")
    return packed.unionByName(fixed)


def _units(docs: DataFrame, id_col: str, text_col: str, overhead: int, shard_bytes) -> tuple[DataFrame, DataFrame, int, float]:
    """Rows (uid, id, key, frag, size, crc), units (key, frag, bytes), all bytes, bytes of a shard."""
    text = F.col(text_col).cast("string")
    rows = reliable_checkpoint(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc")))
    groups = reliable_checkpoint(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    room = shard_bytes(total)
    # at most total / room groups are larger than a shard: a bounded broadcast
    large = groups.where(F.col("bytes") > room).select(
        "key", F.ceil(F.col("bytes") * FRAGMENTS / F.lit(room)).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn(
        "frag", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))).drop("parts")
    cut = rows.join(F.broadcast(large.select("key")), "key", "left_semi").groupBy("key", "frag").agg(F.sum("size").alias("bytes"))
    whole = groups.where(F.col("bytes") <= room).select("key", F.lit(0).alias("frag"), "bytes")
    return rows, reliable_checkpoint(whole.unionByName(cut)), total, room


def _place(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, numbered without gaps per shard."""
    n = shuffle_partitions(rows.sparkSession)
    placed = (rows.join(packed.select("key", "frag", "shard"), ["key", "frag"])
                  .repartitionByRange(n, "shard", "uid").sortWithinPartitions("shard", "uid")
                  .withColumn("pid", F.spark_partition_id()))
    placed = reliable_checkpoint(placed.withColumn(
        "at", F.monotonically_increasing_id() - F.shiftleft(F.col("pid").cast("long"), 33)))
    # a row per partition and shard it holds: partitions + shards rows
    runs = placed.groupBy("pid", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("pid", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return (placed.join(small_side(runs, 500_000), ["pid", "shard"])
                  .withColumn("slot", F.col("at") + F.col("shift"))
                  .select("id", "size", "crc", "shard", "slot"))


def into_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``id``, ``size``, ``crc``, ``shard`` (0 to shards - 1), ``slot``: bytes
    near equal, each shard's capacity being its even share."""
    rows, units, total, room = _units(docs, id_col, text_col, overhead, lambda t: max(t / shards, 1.0))
    return _place(rows, _pack(units, {s: room for s in range(shards)}, total, strict=False))


def into_capacity(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """The same with as few shards of at most ``capacity`` bytes as best fit
    decreasing finds.  What fits no shard of a round enters the shards of the
    next; a round leaves a small share, so rounds are few."""
    rows, units, total, _ = _units(docs, id_col, text_col, overhead, lambda t: float(capacity))
    worst = units.agg(F.max("bytes")).first()[0] or 0
    if worst > capacity:
        raise ValueError(f"a unit of {worst} bytes exceeds the capacity {capacity}")
    done, base, left, amount = None, 0, units, total
    while amount:
        count = int(-(-amount // capacity))
        packed = reliable_checkpoint(_pack(left, {base + s: float(capacity) for s in range(count)}, amount, strict=True))
        fits = packed.where(F.col("shard").isNotNull())
        done = fits if done is None else done.unionByName(fits)
        base += count
        left = packed.where(F.col("shard").isNull()).drop("shard")
        amount = left.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return _place(rows, units.withColumn("shard", F.lit(0)) if done is None else done)
