"""Ranked lexical search against a brute-force ranking."""
import math
import random
import re

import numpy as np
import pytest

from ledgerline.llm import lexical
from ledgerline.llm.common import prepare

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    texts = [(i, words(t)) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n_docs, total = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        ranked = []
        for i, w in texts:
            m = 100 - 75 + 75 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 8 * m))
                        for t in words(text) if t in df)
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(ranked)[:k])]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Ärger", "ärger", "ÉCOLE", "x1y", "naïve"]
    docs = [(i * 13 % 701, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "... !!"), (903, "w1 " * 30000), (None, docs[3][1]), (3, docs[5][1]), (3, docs[5][1]), (904, "W1,w2;[W2]\x00w3")]
    docs += [(1000 + i, "same words here w2") for i in range(40)]  # ties
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(25)]
    items += [(50, None), (51, "..."), (52, "unknownterm"), (53, "same same words"), (None, "w2 Ärger"), (54, "W1 w1"), (54, "here")]
    return docs, items


@pytest.mark.parametrize("k,query_bytes", [(10, 8 << 20), (3, 700)])
def test_matches_brute_force(spark, monkeypatch, corpus, k, query_bytes):
    docs, items = corpus
    prepare(spark)
    monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)  # several blocks of items
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    got = sorted(str(tuple(r)) for r in lexical.best_documents(d, q, k).select("item_id", "rank", "id", "score").collect())
    assert got == brute(docs, items, k)


def test_small_blocks_and_accumulator_limit(monkeypatch):
    """Blocks of a few documents give the same result, and few accumulators are made."""
    import pyarrow as pa

    class Value:
        def __init__(self, value):
            self.value = value

    rng = random.Random(8)
    docs = [(i, " ".join(["the"] * rng.randint(1, 9) + ["of"] * rng.randint(0, 3) + (["rare"] if i % 50 == 0 else []))) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["id", "text"])
    for block_docs in (1000, 64):
        monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
        blocks = [r for b in lexical._index(Value([b"of", b"rare", b"the"]))(iter([batch])) for r in b.to_pylist()]
        total = sum(b["n_terms"] for b in blocks)
        df = {t: sum(b["counts"][b["terms"].index(t)] for b in blocks if t in b["terms"]) for t in range(3)}
        weight = lexical._weights(df, 3, 1000)
        best, made = [], 0
        for b in blocks:
            block = lexical.Block(b, weight, 1000, total)
            place, score, n = block.search([(1, 1), (0, 1), (2, 1)], 5, best[4][0] if len(best) >= 5 else 0)
            made += n
            best = sorted(best + list(zip(score.tolist(), block.ids[place].tolist())), key=lambda x: (-x[0], x[1]))[:5]
            assert not block.live.any() and not block.score.any()
        assert [(0, r + 1, i, s) for r, (s, i) in enumerate(best)] == sorted(eval(x) for x in brute(docs, [(0, "rare of the")], 5))
        assert made < 300  # of 1,000 documents that hold a term


def test_empty_tables(spark):
    prepare(spark)
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.best_documents(d.limit(0), q).count() == 0
    assert lexical.best_documents(d, q.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.best_documents(d, q).select("rank", "id").collect()] == [(1, 1)]


def test_terms():
    text = "ABC déjà-VU\x7f x_y Ünï 12.5"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == words(text)
    assert np.array_equal(lexical._weights({0: 1}, 2, 3), [math.floor(1000 * math.log(8 / 3)), math.floor(1000 * math.log(8))])
