"""Best-fit-decreasing sharding."""
import random
from collections import defaultdict

from ledgerline.llm import sharding
from ledgerline.llm.common import prepare


def test_tree_against_a_sorted_list():
    rng, tree, plain = random.Random(7), sharding.Tree(), []
    for step in range(4000):
        if plain and rng.random() < 0.45:
            x = rng.choice(plain)
            plain.remove(x)
            tree.remove(x)
        else:
            x = (rng.randint(0, 60), step)
            plain.append(x)
            tree.add(x)
        size = rng.randint(0, 65)
        assert tree.tightest(size) == min((x for x in plain if x[0] >= size), default=None)
        if plain:
            assert tree.widest() == max(plain)
            assert tree.root[3] <= 1.45 * len(plain).bit_length() + 2


def test_best_fit_is_tightest():
    spots = sharding.best_fit_decreasing([6, 5, 4, 3, 2], {0: 10, 1: 10}, True)
    assert spots == [0, 1, 0, 1, 1]
    assert sharding.best_fit_decreasing([11, 1], {0: 10}, True) == [None, 0]
    assert sharding.best_fit_decreasing([1], {}, False) == [None]


def check(rows, got, shards):
    sizes, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    by_id = dict(rows)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[by_id[r.id]].add(r.shard)
        assert r.size == len((by_id[r.id] or "").encode()) + 16
    assert len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, groups


def test_even_bytes_groups_whole(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(8)
    texts = [None, None, "", ""] + ["é" * rng.randint(0, 400) + str(i) for i in range(3000)]
    texts += [t for t in texts[10:40] for _ in range(5)] + ["hot" * 100] * 1800
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int")
    for units in (20_000, 300):
        monkeypatch.setattr(sharding, "CELL_UNITS", units)
        got = sharding.into_shards(df, 10).collect()
        sizes, groups = check(rows, got, 10)
        total = sum(sizes.values())
        assert set(sizes) == set(range(10))
        assert max(sizes.values()) - min(sizes.values()) <= 0.02 * total / 10
        assert all(len(s) == 1 for t, s in groups.items() if t != "hot" * 100)
        assert len(groups["hot" * 100]) > 1


def test_fixed_capacity(spark):
    prepare(spark)
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(0, 300) + str(i)) for i in range(1200)]
    got = sharding.into_capacity(spark.createDataFrame(rows, "doc_id long, text string"), 5000).collect()
    sizes, groups = check(rows, got, None)
    assert max(sizes.values()) <= 5000
    assert len(sizes) <= -(-sum(sizes.values()) // 5000) + 2
    assert all(len(s) == 1 for s in groups.values())


def test_empty_and_few(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")
    assert sharding.into_shards(df.limit(0), 40).count() == 0
    got = sharding.into_shards(df, 40).collect()
    assert sorted(r.size for r in got) == [16, 16, 17]
