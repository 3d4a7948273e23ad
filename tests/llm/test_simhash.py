"""SimHash near-duplicates against brute force."""
import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.common import prepare


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    prints = [f for _, f in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in out.items()}
    return [least[find(i)] for i in range(len(rows))]


def test_golay_corrects_three_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 200)
    base = simhash.decode(words)
    assert len(np.unique(simhash.decode(np.arange(1 << 23)), return_counts=True)[1]) == 4096
    for w, c in zip(words[:20], base):
        code = [v for v in (int(w) ^ (1 << a) ^ (1 << b) for a in range(23) for b in range(a)) if True]
        assert c in simhash.decode(np.array(code + [w]))


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(4000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        rows, keys = simhash.golay_keys(np.array([x, y], np.uint64))
        a, b = keys[rows == 0], keys[rows == 1]
        exact = {k for k in a if (k >> 37) < 6} & {k for k in b if (k >> 37) < 6}
        cross = {int(k) ^ 1 for k in a if (k >> 37) >= 6} & {int(k) for k in b if (k >> 37) >= 6}
        assert exact or cross


@pytest.mark.parametrize("hot,small", [(8192, 48), (5, 2)])
def test_components_match_brute_force(spark, monkeypatch, hot, small):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for t in list(texts[:30]):
        for _ in range(4):
            w = t.split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w).upper())
    texts += [None, "", "  ", "one", "One two", texts[5], texts[5], "x " * 5000]
    rows = [(i * 7 % 331, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None), (None, "all alone here now", None)]
    rows += [rows[3], rows[3]]
    prepare(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    if hot == 8192:
        got = simhash.near_duplicates(df).collect()
        prints = [(d, brute_print(t)) for d, t, _ in rows]
        want = sorted((str(d), f, str(c)) for (d, f), c in zip(prints, brute_components(prints)))
        assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    else:  # dense fingerprints, hot groups cut into blocks
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "SMALL", small)
        fps = {rng.getrandbits(64)}
        while len(fps) < 300:
            fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps = np.array(sorted(fps), np.uint64)
        rows_, keys = simhash.golay_keys(fps)
        order = np.argsort(keys, kind="stable")
        import pyarrow as pa
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[o]), pa.array(fps[rows_[o]].view(np.int64))], names=["k", "fp"])
                   for o in np.array_split(order, 40)]
        edges, blocks = [], {}
        for out in simhash._verify(iter(batches)):
            for r in out.to_pylist():
                if r["data"] is None:
                    edges.append((r["a"] % (1 << 64), r["b"] % (1 << 64)))
                else:
                    blocks.setdefault(r["grp"], []).append(np.frombuffer(r["data"], np.uint64))
        assert blocks
        for parts in blocks.values():
            for i, x in enumerate(parts):
                for y in parts[i:]:
                    a, b = simhash._links_large(x, y)
                    edges += list(zip(a.tolist(), b.tolist()))
        nodes, root = simhash.stars(np.array([e[0] for e in edges], np.uint64), np.array([e[1] for e in edges], np.uint64))
        got = dict(zip(nodes.tolist(), root.tolist()))
        pairs = [(x, y) for i, x in enumerate(fps.tolist()) for y in fps.tolist()[:i] if (x ^ y).bit_count() <= 4]
        nodes, root = simhash.stars(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64))
        assert got == dict(zip(nodes.tolist(), root.tolist()))


def test_empty_table(spark):
    prepare(spark)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
