"""Market-basket analyses over lineitem ⋈ part (transaction = l_orderkey,
item = p_brand, date = l_shipdate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import basket
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table

MIN_SUPPORT = 0.01
MIN_LIFT = 0.5


def lines(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return basket.basket_lines(j, "l_orderkey", "p_brand", "l_shipdate")


_LINES = "(SELECT l_orderkey AS tx, p_brand AS item, l_shipdate AS date FROM lineitem JOIN part ON l_partkey = p_partkey)"


@register("basket_collect", sql=f"""
SELECT tx, array_to_string(list_sort(list_distinct(list(item))), ',') AS items, count(*) AS n_lines
FROM {_LINES} GROUP BY tx""")
def q_basket_collect(spark, d):
    b = basket.basket_collect(lines(spark, d))
    return b.select("tx", F.array_join("items", ",").alias("items"), "n_lines")


@register("basket_summary", sql=f"""
WITH p AS (SELECT tx, item, count(*) AS n FROM {_LINES} GROUP BY tx, item),
s AS (SELECT sum(n) AS lines, count(*) AS pairs, count(DISTINCT tx) AS transactions,
             count(DISTINCT item) AS unique_items FROM p)
SELECT transactions, unique_items, CAST(lines AS BIGINT) AS lines,
       round(lines / transactions, 6) AS avg_basket_size,
       round(1 - pairs / (transactions * unique_items), 6) AS sparsity FROM s""")
def q_basket_summary(spark, d):
    s = basket.basket_summary(lines(spark, d))
    return s.select("transactions", "unique_items", F.col("lines").cast("long").alias("lines"),
                    F.round("avg_basket_size", 6).alias("avg_basket_size"),
                    F.round("sparsity", 6).alias("sparsity"))


@register("basket_top_items", sql=f"""
SELECT item, count(*) AS count FROM {_LINES} GROUP BY item ORDER BY count DESC, item LIMIT 10""")
def q_basket_top_items(spark, d):
    return basket.top_items(lines(spark, d), 10)


@register("basket_monthly", sql=f"""
SELECT strftime(date, '%Y-%m') AS month, count(*) AS lines FROM {_LINES} GROUP BY 1""")
def q_basket_monthly(spark, d):
    return basket.monthly_counts(lines(spark, d))


_ITEMSETS_CTE = f"""
WITH b AS (SELECT DISTINCT tx, item FROM {_LINES}),
n AS (SELECT count(DISTINCT tx) AS n FROM b),
s1 AS (SELECT [item] AS items, count(*) AS freq FROM b GROUP BY item),
s2 AS (SELECT [x.item, y.item] AS items, count(*) AS freq FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item
       GROUP BY x.item, y.item),
s3 AS (SELECT [x.item, y.item, z.item] AS items, count(*) AS freq
       FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item JOIN b z ON y.tx = z.tx AND y.item < z.item
       GROUP BY x.item, y.item, z.item),
its AS (SELECT items, freq, freq / n AS support FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), n
        WHERE freq >= ceil({MIN_SUPPORT} * n))
"""


def itemsets(spark, d):
    baskets = basket.basket_collect(lines(spark, d))
    return basket.frequent_itemsets(baskets, MIN_SUPPORT)


@register("basket_itemsets", sql=_ITEMSETS_CTE + """
SELECT array_to_string(items, ',') AS items, CAST(freq AS BIGINT) AS freq, round(support, 6) AS support FROM its""")
def q_basket_itemsets(spark, d):
    it = itemsets(spark, d)
    return it.select(F.array_join("items", ",").alias("items"), "freq", F.round("support", 6).alias("support"))


@register("basket_rules", sql=_ITEMSETS_CTE + f""",
splits AS (SELECT items, support, m FROM its, range(1, CAST(pow(2, len(items)) AS BIGINT) - 1) t(m)
           WHERE len(items) >= 2),
r AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS antecedents,
             list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS consequents, support FROM splits),
m AS (SELECT r.antecedents, r.consequents, a.support AS antecedent_support, c.support AS consequent_support,
             r.support, r.support / a.support AS confidence
      FROM r JOIN its a ON a.items = r.antecedents JOIN its c ON c.items = r.consequents)
SELECT array_to_string(antecedents, ',') AS antecedents, array_to_string(consequents, ',') AS consequents,
       round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support,
       round(support, 6) AS support, round(confidence, 6) AS confidence,
       round(confidence / consequent_support, 6) AS lift,
       round(support - antecedent_support * consequent_support, 6) AS leverage,
       CASE WHEN confidence >= 1 THEN NULL ELSE round((1 - consequent_support) / (1 - confidence), 6) END AS conviction
FROM m WHERE confidence / consequent_support >= {MIN_LIFT}""")
def q_basket_rules(spark, d):
    r = basket.association_rules(itemsets(spark, d), "lift", MIN_LIFT)
    return r.select(F.array_join("antecedents", ",").alias("antecedents"),
                    F.array_join("consequents", ",").alias("consequents"),
                    *[F.round(c, 6).alias(c) for c in ("antecedent_support", "consequent_support", "support",
                                                       "confidence", "lift", "leverage", "conviction")])


@register("rules_subset_join", sql=_ITEMSETS_CTE + """,
splits AS (SELECT items, support, m FROM its, range(1, CAST(pow(2, len(items)) AS BIGINT) - 1) t(m) WHERE len(items) >= 2),
r AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS antecedents,
             list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS consequents FROM splits)
SELECT array_to_string(r.antecedents, ',') AS antecedents, array_to_string(r.consequents, ',') AS consequents,
       round(a.support, 6) AS antecedent_support, round(c.support, 6) AS consequent_support
FROM r JOIN its a ON a.items = r.antecedents JOIN its c ON c.items = r.consequents""")
def q_rules_subset_join(spark, d):
    """The itemset lookups behind the rules: every split of every frequent
    itemset joined to the supports of its two sides (equi-join on the sorted
    item array), before any metric threshold."""
    r = basket.association_rules(itemsets(spark, d), "lift", float("-inf"))
    return r.select(F.array_join("antecedents", ",").alias("antecedents"),
                    F.array_join("consequents", ",").alias("consequents"),
                    F.round("antecedent_support", 6).alias("antecedent_support"),
                    F.round("consequent_support", 6).alias("consequent_support"))
