"""Exact top-n similarity against all scores."""
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import text as TX


@pytest.mark.parametrize("n,low", [(3, 0.0), (5, 0.3), (1, 0.05)])
def test_equals_the_ranked_scores(spark, n, low):
    rng = random.Random(n)
    words = [f"word{int(rng.paretovariate(0.7))}" for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    docs += [(300 + i, docs[i][1]) for i in range(10)] + [(400, None), (401, "the of")]
    queries = [(i, " ".join(rng.sample(docs[i][1].split() * 2 + words, 12))) for i in range(20)] + [(50, None), (51, "unseen nothing"), (52, "word1")]
    q = spark.createDataFrame(queries, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    every = TX.tfidf_similarity(q, "item_id", "text", d, "doc_id", "text").withColumn("score", F.round("score", 9))
    even = lambda pairs: pairs.filter("doc_id % 3 > 0")
    for keep in (None, even):
        want = TX.top_matches(keep(every) if keep else every, "item_id", "doc_id", n, low)
        got = TX.top_similar(q, "item_id", "text", d, "doc_id", "text", n, low, keep)
        rows = lambda x: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 7)) for r in x.collect())
        assert rows(got) == rows(want) and got.count() > 5


def test_empty_sides(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    d = spark.createDataFrame([(1, "alpha gamma")], "doc_id long, text string")
    assert TX.top_similar(q.limit(0), "item_id", "text", d, "doc_id", "text").count() == 0
    assert TX.top_similar(q, "item_id", "text", d.limit(0), "doc_id", "text").count() == 0
