"""Near-duplicate passages: windows against definitions, classes against brute force."""
import random

import numpy as np

from ledgerline.llm import passages as ps
from ledgerline.llm.common import prepare


def test_compact_windows_are_cartesian_subtrees():
    rng = np.random.default_rng(12)
    for _ in range(20):
        sizes = rng.integers(1, 400, 4)
        doc = np.repeat(np.arange(4), sizes)
        values = rng.permutation(10 * len(doc))[:len(doc)].astype(np.uint64)
        last = np.concatenate([doc[ps.SPAN - 1:], np.full(ps.SPAN - 1, -1)])
        got = sorted(zip(*(x.tolist() for x in ps.compact_windows(values, doc, last)[2:5])))
        want = []
        for d in range(4):
            at = np.flatnonzero(doc == d)
            stack = [(int(at[0]), int(at[-1]))]
            while stack:
                a, b = stack.pop()
                if b - a + 1 >= ps.SPAN:
                    c = a + int(np.argmin(values[a:b + 1]))
                    want.append((a, c, b))
                    stack += [(a, c - 1), (c + 1, b)]
        assert got == sorted(want)


def brute_classes(rows):
    """Components of ids that share 50 lower-case words in a row."""
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    first = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        for p in range(len(words) - 49 if i is not None else 0):
            w = tuple(words[p:p + 50])
            j = first.setdefault(w, i)
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def make(rng, repeats):
    vocab = ["the", "of", "and"] * 10 + [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [text(rng.choice([25, 50, 51, 60, 120])) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 150))]
        if rng.random() < 0.5:
            for s in rng.sample(shared, rng.choice([1, 1, 1, 2])):
                parts += [repeats(s, rng), text(rng.randint(0, 100))]
        words = [w for p in parts for w in p]
        rows.append((1000 - i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows, shared


def test_repeated_passages_match_brute_force(spark):
    prepare(spark)
    rng = random.Random(13)
    rows, shared = make(rng, lambda s, r: [w.upper() for w in s] if r.random() < 0.3 else s)
    rows += [(5, None), (6, ""), (None, " ".join(shared[3])), rows[0], (rows[1][0], rows[2][1]), (7, "a " * 5000), (8, "a " * 70)]
    rows += [(2000 + k, rows[3][1]) for k in range(30)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int").repartition(6)
    got = ps.passage_classes(df).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {r.id: r.class_id for r in got if r.id is not None} == want
    sizes = {}
    for i, c in want.items():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r.class_size == sizes[r.class_id] for r in got if r.id is not None)
    assert [r.class_id for r in got if r.id is None] == [None]


def test_near_passages_found_and_clean_left(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(14)
    vocab = [f"w{k}" for k in range(600)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, groups = [], []
    for g in range(25):
        base, own = text(150), []
        for _ in range(3):
            s = list(base)
            for at in rng.sample(range(150), 2):  # ten of 146 shingles differ
                s[at] = "edit%d" % rng.randrange(10 ** 6)
            rows.append((len(rows), " ".join(text(30) + s + text(30))))
            own.append(rows[-1][0])
        groups.append(own)
    clean = range(len(rows), len(rows) + 60)
    rows += [(i, " ".join(text(200))) for i in clean]
    for block in (128, 2):
        monkeypatch.setattr(ps, "BLOCK", block)
        got = {r.id: r.class_id for r in ps.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[i] == i for i in clean)
        assert sum(len({got[i] for i in own}) == 1 for own in groups) >= 24
        assert len({got[own[0]] for own in groups}) == 25


def test_similar():
    rng = np.random.default_rng(15)
    x = rng.integers(0, 1 << 60, 120).astype(np.uint64)
    y = rng.integers(0, 1 << 60, 120).astype(np.uint64)
    assert not ps.similar(x, y)
    y[40:86] = x[10:56]
    assert ps.similar(x, y) and ps.similar(y, x)
    y[60:70] = 1
    assert not ps.similar(x, y)


def test_empty(spark):
    prepare(spark)
    assert ps.passage_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stretches_of_long_repetitive_regions():
    rng = np.random.default_rng(16)
    x = np.tile(rng.integers(0, 1 << 30, 60), 1500).astype(np.uint32)
    y = np.concatenate([rng.integers(0, 1 << 30, 90_000).astype(np.uint32), x[30:90]])
    assert ps.similar(x, y) and not ps.similar(x, y[:90_000])


def test_recall_of_50_words_at_the_required_similarity(spark):
    """One word of 50 differs: 41 of 51 shingles are common, Jaccard 0.804."""
    prepare(spark)
    rng = random.Random(17)
    text = lambda n: ["w%d" % rng.randrange(10 ** 6) for _ in range(n)]
    rows, n = [], 400
    for k in range(n):
        base = text(50)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(text(60) + base + text(60))))
            base = [*base[:25], "edit", *base[26:]]
    got = {r.id: r.class_id for r in ps.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(n))
    assert sum(got[2 * k + 1] == 2 * k for k in range(n)) >= 0.95 * n
