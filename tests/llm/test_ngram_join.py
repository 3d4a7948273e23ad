"""PartEnum join against brute force."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import ngram_join
from ledgerline.llm.common import prepare, table


def brute_set(text, shingle=3):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def brute(rows, percent=90):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            root[find(i)] = find(by_id.setdefault(d, i))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and rows[i][0] is not None and rows[j][0] is not None and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(None if d is None else least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def result(df, **kw):
    return sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(df, **kw).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 14, 30, 80, 200]))]
        if rng.random() < 0.4:
            words += shared
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 3, 8])):  # near the threshold on both sides
            w = list(words)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    return texts


def test_components_match_brute_force(spark):
    texts = corpus(3, 90) + [None, "", " \n", "one", "One", "one two", "x " * 30000, "a b c", "c b a"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone"), (7, texts[5]), (7, texts[5]), (14, texts[40])]
    prepare(spark)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    assert result(df) == brute(rows)


@pytest.mark.parametrize("cut", [4, 1000])
def test_hot_groups_in_blocks(spark, monkeypatch, cut):
    """Sets around the threshold, which share many signatures, in blocks of three."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.sample(range(60), rng.randint(0, 3)):
            w[p] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    prepare(spark)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "CUT", cut)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize("percent", [90, 80])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = rng.integers(0, 1 + n // 8), rng.integers(0, 1 + n // 8)
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and not np.array_equal(x, y):
            own = np.repeat([0, 1], [len(x), len(y)])
            for seed in (0, 1):
                doc, sig = ngram_join.signatures(own, np.concatenate([x, y]), 2, percent, seed)
                assert np.intersect1d(sig[doc == 0], sig[doc == 1]).size


def test_sketches_are_no_further_than_the_sets():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 600))).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.integers(0, len(x)):], rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)]))
        a, b = ngram_join._sketch(x), ngram_join._sketch(y)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(ngram_join._fold(a, size) ^ ngram_join._fold(b, size)).sum())
        assert differ <= len(np.setxor1d(x, y))


def test_walk_over_batches_and_borders(monkeypatch):
    rng = random.Random(6)
    rows = sorted({(rng.randrange(40), rng.randrange(30)) for _ in range(200)})
    rows = sorted(rows + rng.sample(rows, 30))
    monkeypatch.setattr(ngram_join, "WALK_ROWS", 7)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i:i + 3]]), pa.array([r[1] for r in rows[i:i + 3]])], names=["sig", "id"])
               for i in range(0, len(rows), 3)]
    got = [r for b in ngram_join._walk(iter(batches)) for r in b.to_pylist()]
    groups = {}
    for s, i in rows:
        groups.setdefault(s, set()).add(i)
    assert sorted((r["sig"], r["id"], r["head"]) for r in got if not r["border"]) == sorted(
        (s, i, min(g)) for s, g in groups.items() if len(g) > 1 for i in g)
    assert [(r["sig"], r["head"]) for r in got if r["border"]] == [(s, min(groups[s])) for s in (rows[0][0], rows[-1][0])]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = (" ".join(f"word{i % 977}" for i in range(20000)) + " " + "y" * 5000 + "\nend").encode()
    whole = ngram_join.shingle_sets([text, b"a b"], 3)
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 1000)
    pieces = ngram_join.shingle_sets([text, b"a b"], 3)
    assert all(np.array_equal(x, y) for x, y in zip(whole, pieces)) and (whole[0] == 0).sum() == len(brute_set(text.decode()))


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == brute(rows)


def test_empty_table(spark):
    prepare(spark)
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
