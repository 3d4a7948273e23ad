"""Market-basket analysis: basket statistics, frequent itemsets, all-split
association rules.

Itemsets come from Spark's distributed FP-growth (no transaction × item
one-hot matrix, no pair explosion inside a basket).  Rules enumerate the
proper subsets of each frequent itemset (at most 2^max_len − 2 per itemset)
and look both sides up in the itemset table with an equi-join on the
sorted-array key.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import reliable_checkpoint


def basket_lines(df: DataFrame, tx_col: str, item_col: str, date_col: str | None = None) -> DataFrame:
    """(tx, item[, date]) with null keys dropped."""
    cols = [F.col(tx_col).alias("tx"), F.col(item_col).cast("string").alias("item")]
    if date_col:
        cols.append(F.col(date_col).alias("date"))
    return df.select(*cols).dropna(subset=["tx", "item"])


def basket_collect(lines: DataFrame) -> DataFrame:
    """Per transaction: distinct items (sorted) and line count.  collect_set
    is partially aggregated map-side and bounded by the distinct items of a
    basket."""
    return lines.groupBy("tx").agg(F.array_sort(F.collect_set("item")).alias("items"),
                                   F.count(F.lit(1)).alias("n_lines"))


def basket_summary(lines: DataFrame) -> DataFrame:
    """transactions, unique items, mean basket size (duplicates counted),
    distinct (tx,item) pairs and matrix sparsity."""
    pairs = lines.groupBy("tx", "item").agg(F.count(F.lit(1)).alias("n"))
    pairs = reliable_checkpoint(pairs)
    per_tx = pairs.groupBy("tx").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("p"))
    s = per_tx.agg(F.sum("n").alias("lines"), F.sum("p").alias("pairs"), F.count(F.lit(1)).alias("transactions"))
    s = s.crossJoin(pairs.select("item").distinct().agg(F.count(F.lit(1)).alias("unique_items")))
    return s.select("transactions", "unique_items", "lines",
                    (F.col("lines") / F.col("transactions")).alias("avg_basket_size"),
                    (1 - F.col("pairs") / (F.col("transactions") * F.col("unique_items"))).alias("sparsity"))


def top_items(lines: DataFrame, k: int = 10) -> DataFrame:
    """k most frequent items (line count, ties by item)."""
    return lines.groupBy("item").agg(F.count(F.lit(1)).alias("count")) \
                .orderBy(F.desc("count"), "item").limit(k)


def monthly_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.date_format("date", "yyyy-MM").alias("month")) \
                .agg(F.count(F.lit(1)).alias("lines"))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.01, max_len: int = 10,
                      num_partitions: int | None = None) -> DataFrame:
    """items (sorted array), freq, support = freq / transactions."""
    # the fit passes over its input several times: baskets are written once
    baskets = reliable_checkpoint(baskets.select("items"))
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(baskets)
    n_tx = baskets.agg(F.count(F.lit(1)).alias("_n"))
    return model.freqItemsets.filter(F.size("items") <= max_len) \
        .crossJoin(n_tx) \
        .select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"),
                (F.col("freq") / F.col("_n")).alias("support"))


def association_rules(itemsets: DataFrame, metric: str = "lift", min_threshold: float = 0.5) -> DataFrame:
    """Every split of every frequent itemset (size ≥ 2) into antecedent →
    consequent, with support, confidence, lift, leverage, conviction
    (null = infinite, i.e. confidence 1)."""
    # read three times below (splits, antecedent and consequent lookups): the
    # mining behind it must not run three times
    itemsets = reliable_checkpoint(itemsets)
    multi = itemsets.filter(F.size("items") >= 2)
    splits = multi.select(
        "items", F.col("support"),
        F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)).alias("_mask"))
    splits = splits.select(
        "support",
        F.expr("filter(items, (v, i) -> (shiftright(_mask, i) & 1) = 1)").alias("antecedents"),
        F.expr("filter(items, (v, i) -> (shiftright(_mask, i) & 1) = 0)").alias("consequents"))
    a = itemsets.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    c = itemsets.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    r = splits.join(a, "antecedents").join(c, "consequents")
    conf = F.col("support") / F.col("antecedent_support")
    r = r.withColumn("confidence", conf) \
         .withColumn("lift", F.col("confidence") / F.col("consequent_support")) \
         .withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support")) \
         .withColumn("conviction", F.when(F.col("confidence") >= 1, F.lit(None).cast("double"))
                     .otherwise((1 - F.col("consequent_support")) / (1 - F.col("confidence"))))
    return r.filter(F.col(metric) >= min_threshold).select(
        "antecedents", "consequents", "antecedent_support", "consequent_support",
        "support", "confidence", "lift", "leverage", "conviction")
