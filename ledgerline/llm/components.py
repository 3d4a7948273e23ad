"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum (combined before its shuffle) and a join on
the node; each round is written to the shared folder, so a lost executor
re-reads one round.  Nothing but two counters per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import reliable_checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) of every node in an
    edge; ``edges`` has two columns ``a``, ``b`` of one ordered type.  Raises
    if ``max_rounds`` do not suffice (they halve distances, so they do)."""
    edges = reliable_checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                                     .where(F.col("a") != F.col("b")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = reliable_checkpoint(large.distinct())
        # small star: u and its smaller neighbours point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = reliable_checkpoint(small)
        new = _state(edges)
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = new
    raise RuntimeError("components did not settle")
