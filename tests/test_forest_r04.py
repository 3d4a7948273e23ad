"""Two-code features by their rarer rows, and the rows of a node by code tables, against plain forms."""
import numpy as np
import pyarrow as pa
import pytest

from ledgerline.operators import forest


def _codes(rng, n):
    c = rng.integers(0, 9, n)
    wide = [(c == k) for k in range(10)] + [c != 3]
    return np.stack([rng.integers(0, 40, n), *wide, np.where(rng.random(n) < 0.1, 255, 0)], axis=1).astype(np.uint8), c


@pytest.mark.parametrize("seed", range(4))
def test_root_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    codes, c = _codes(rng, 300)
    y, w = np.round(c * [1, 5, 0, 3][seed] + rng.normal(size=300), 2), rng.integers(1, 4, 300).astype(float)
    tree = forest.grow_tree(codes, y, w, [seed], min_leaf=3)
    score = {}
    for f in range(codes.shape[1]):
        for k in np.unique(codes[:, f])[:-1]:
            left = codes[:, f] <= k
            if min(left.sum(), (~left).sum()) >= 3:
                score[f, int(k)] = sum((w * y)[s].sum() ** 2 / w[s].sum() for s in (left, ~left))
    assert score[tree["feature"][0], tree["code"][0]] == pytest.approx(max(score.values()))
    leaf = forest.leaf_of(tree, codes)
    assert np.bincount(leaf)[np.unique(leaf)].min() >= 3
    assert np.allclose(tree["value"][np.unique(leaf)], [(w * y)[leaf == k].sum() / w[leaf == k].sum() for k in np.unique(leaf)])


def test_rows_arrive_where_the_path_ends():
    rng = np.random.default_rng(9)
    codes, c = _codes(rng, 2000)
    tree = forest.grow_tree(codes, c + rng.normal(size=2000), np.ones(2000), [1], min_leaf=5)
    nodes = np.flatnonzero(tree["feature"] < 0)
    assert len(nodes) > 128  # several groups of bits
    leaf = forest.leaf_of(tree, codes)
    for some in (nodes.tolist(), nodes[::3].tolist(), nodes[:1].tolist()):
        place = {node: i for i, node in enumerate(some)}
        assert forest._arrive(forest._boxes(tree, some), len(some), codes).tolist() == [place.get(x, -1) for x in leaf]
    alone = {"feature": np.array([-1]), "code": np.array([0]), "left": np.array([-1])}
    assert (forest._arrive(forest._boxes(alone, [0]), 1, codes) == 0).all()


def test_sums_of_nodes():
    rng = np.random.default_rng(2)
    codes, c = _codes(rng, 500)
    uid, y, w = rng.integers(0, 1 << 60, 500), np.round(rng.normal(size=500), 2), rng.integers(1, 3, 500).astype(float)
    edges = [np.arange(39.0)] + [np.array([0.5])] * 9 + [np.zeros(0)] + [np.array([0.5])] + [np.zeros(0)]
    top = {"feature": np.array([11, -1, 1, -1, -1]), "code": np.zeros(5, int), "left": np.array([1, -1, 3, -1, -1]), "level": np.array([0, 1, 1, 2, 2])}
    plan = type("Plan", (), {"value": ({0: top, 3: top}, {0: [1, 3], 3: [4]})})
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (uid, codes, y, w)], names=["uid", "codes", "y", "w"])
    starts, place = forest._places(edges)
    leaf, seen = forest.leaf_of({**top, "level": top["level"]}, codes), set()
    for out in forest._histograms(plan, edges, 42)(iter([batch])):
        for tree, node, sums in zip(*[out.column(i).to_pylist() for i in range(3)]):
            got, ww = np.frombuffer(sums).reshape(-1, 4), w * forest.bag(uid, tree, 42)
            own = (leaf == node) & (ww > 0)
            for f in range(codes.shape[1]):
                for k in np.unique(codes[:, f]):
                    at = own & (codes[:, f] == k)
                    assert np.allclose(got[place[f, k], :3], [at.sum(), ww[at].sum(), (ww * y)[at].sum()])
            assert got[:starts[1], 3].sum() == pytest.approx((ww * y * y)[own].sum())
            seen.add((tree, node))
    assert seen == {(0, 1), (0, 3), (3, 4)}
