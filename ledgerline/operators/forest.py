"""Forests of trees without a depth limit, and model searches over one binned table.

*Growing.*  Features are cut into at most 255 bins by their quantiles and the
rows are written once as blocks of bin codes.  Every tree draws its bag by a
hash of the row key, so no bag is stored and a lost task draws the same one.
While a node holds more than ``LOCAL_ROWS`` rows it is split by histograms: each
task sums (weight, weighted label) per open node, feature and bin, the sums
are merged by a shuffle and a task per node picks the split; at most
``NODES_AT_ONCE`` nodes take part in a pass.  A node of at most ``LOCAL_ROWS``
rows is dealt to one task that grows the rest of its subtree.  Trees are grown
side by side, so a forest takes a fixed number of passes, not one per tree.

*Scoring.*  A forest of at most ``MODEL_BYTES`` is sent to the tasks and applied in
one narrow pass.  A larger one never comes to the driver: blocks of rows are
routed through the upper parts of the trees and meet the subtrees there by a
shuffle, each row once a tree, and a block's values are put together again.

*Searching.*  Points of a grid are compared by cross-validation over all rows.  A forest
of 100 trees is the first half of one of 200 and a shallow tree the top of a deep
one, so points that differ in number of trees, rounds or depth share their fits.
``best_point`` fits a table of at most ``SEARCH_ROWS`` rows whole in every task and
spreads the fits; the fits of a larger one are distributed themselves (``ml.search``).

Labels are numbers; 0 / 1 labels give class probabilities, as the variance of
a 0 / 1 label orders splits as the Gini index does.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint

LOCAL_ROWS = 100_000
NODES_AT_ONCE = 1024
HISTOGRAM_BYTES = 64 << 20
BLOCK_ROWS = 8192
SCORE_BLOCK_ROWS = 32768
SCORE_ROWS = 1 << 20
BATCH_BYTES = 8 << 20
MODEL_BYTES = 64 << 20
SEARCH_ROWS = 20_000
BINS = 255
FEW_CODES = 32
BATCH_TREES = 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


# ------------------------------------------------------------------ one tree

def grow_tree(codes: np.ndarray, y: np.ndarray, w: np.ndarray, seed, depth: int = 1 << 30, min_leaf: int = 1,
              min_split: int = 2, tried: int | None = None, first_level: int = 0) -> dict:
    """Arrays of one tree, level by level: ``feature`` (-1: leaf), ``code`` (left if not
    above it), ``left`` (the right child follows), ``value``, ``level``; and ``gain`` per feature."""
    n, width = codes.shape
    tried = min(tried or width, width)
    out = {k: [] for k in ("feature", "code", "left", "value", "level")}
    gain = np.zeros(width)
    rows, node, k, level, base = np.arange(n), np.zeros(n, np.int64), 1, first_level, 0
    wy = w * y
    wyy = wy * y
    codes = np.asfortranarray(codes)  # read by feature
    small, rare_f, rare_row, low = {}, [], [], np.zeros(width, np.int64)  # features with few codes are summed by code, the others sorted
    for f in range(width):
        met = np.flatnonzero(np.bincount(codes[:, f], minlength=256))
        if len(met) == 2:  # two codes: only the rows of the rarer one are looked at, as of a category's column
            high = codes[:, f] == met[1]
            rare_row.append(np.flatnonzero(high if 2 * np.count_nonzero(high) <= n else ~high))
            rare_f.append(np.full(len(rare_row[-1]), f))
            low[f] = met[0]
        elif len(met) <= FEW_CODES:
            small[f] = met, np.searchsorted(met, codes[:, f]).astype(np.uint8)
    own_f, own_row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rare_f, rare_row))  # by (node, feature), level by level
    two = set(np.unique(own_f).tolist())
    ordered = {f: np.argsort(codes[:, f], kind="stable") for f in range(width) if f not in small and f not in two}  # by (node, code), level by level
    own_node = np.zeros(n, np.int64)  # node of every row, -1: in no open one
    while k:
        sw, sy = np.bincount(node, w[rows], k), np.bincount(node, wy[rows], k)
        spread = np.bincount(node, wyy[rows], k) - sy * sy / sw
        count = np.bincount(node, minlength=k)
        value = sy / sw
        opened = np.flatnonzero((count >= max(min_split, 2 * min_leaf)) & (spread > 1e-9 * (1 + sy * sy / sw)) & (level < depth))
        feature, code, left = np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.full(k, -1, np.int32)
        if len(opened):
            place = np.full(k, -1)
            place[opened] = np.arange(len(opened))
            keep = place[node] >= 0
            rows, node = rows[keep], place[node[keep]]
            own_node[:] = -1
            own_node[rows] = node
            few_nodes = len(opened) <= 1 << 16  # numbers of 16 bits are sorted by their digits
            sw, sy, count, spread = sw[opened], sy[opened], count[opened], spread[opened]
            start = np.cumsum(count) - count
            best, best_f, best_c = np.full(len(opened), -np.inf), np.full(len(opened), -1), np.zeros(len(opened), np.int64)
            if tried < width:
                draw = np.random.default_rng([*seed, level]).random((len(opened), width))
                allowed = draw <= np.partition(draw, tried - 1, axis=1)[:, tried - 1:tried]
            here_w, here_wy = w[rows], wy[rows]
            for f in range(width):
                if f in two:
                    continue
                if f in small:
                    values, rank = small[f]
                    v, m = len(values), len(opened)
                    if v < 2:
                        continue
                    key = node * v + rank[rows]
                    each = np.bincount(key, minlength=m * v).reshape(m, v)
                    ln, lw, ly = (np.cumsum(x.reshape(m, v), axis=1)[:, :-1]
                                  for x in (each, np.bincount(key, here_w, m * v), np.bincount(key, here_wy, m * v)))
                    right = count[:, None] - ln
                    good = (each[:, :-1] > 0) & (right > 0) & (ln >= min_leaf) & (right >= min_leaf)
                    if tried < width:
                        good &= allowed[:, f, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.where(good, ly * ly / lw + (sy[:, None] - ly) ** 2 / (sw[:, None] - lw), -np.inf)
                    where, first = np.arange(m), score.argmax(axis=1)
                    top = score[where, first]
                    better = top > best + 1e-12 * np.where(np.isfinite(best), np.abs(best), 0)
                    best[better], best_f[better], best_c[better] = top[better], f, values[first[better]]
                    continue
                own = ordered[f]
                at = own_node[own]
                own, at = own[at >= 0], at[at >= 0]
                order = np.argsort(at.astype(np.uint16) if few_nodes else at, kind="stable")
                ordered[f] = own = own[order]
                key = (at[order] << 8) | codes[own, f]
                ends = np.flatnonzero(key[1:] != key[:-1])
                at = key[ends] >> 8
                inner = at == key[ends + 1] >> 8  # a cut between two codes of one node
                ends, at = ends[inner], at[inner]
                n_left = ends + 1 - start[at]
                good = (n_left >= min_leaf) & (count[at] - n_left >= min_leaf)
                if tried < width:
                    good &= allowed[at, f]
                ends, at = ends[good], at[good]
                if not len(ends):
                    continue
                cw, cy = np.cumsum(w[own]), np.cumsum(wy[own])
                before = start[at] - 1
                lw = cw[ends] - np.where(before >= 0, cw[before], 0)
                ly = cy[ends] - np.where(before >= 0, cy[before], 0)
                score = ly * ly / lw + (sy[at] - ly) ** 2 / (sw[at] - lw)
                heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                top = np.maximum.reduceat(score, heads)
                hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(heads, len(at)))))
                where, first = np.unique(at[hit], return_index=True)
                better = top > best[where] + 1e-12 * np.abs(best[where], where=np.isfinite(best[where]), out=np.zeros(len(where)))
                where, first, top = where[better], first[better], top[better]
                best[where], best_f[where], best_c[where] = top, f, key[ends[hit[first]]] & 255
            if len(own_row):
                at = own_node[own_row]
                open_ = at >= 0
                own_f, own_row, at = own_f[open_], own_row[open_], at[open_]
                order = np.argsort(at.astype(np.uint16) if few_nodes else at, kind="stable")
                own_f, own_row, at = own_f[order], own_row[order], at[order]
            if len(own_row):
                begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own_f[1:] != own_f[:-1])]))
                at, by = at[begin], own_f[begin]
                n_rare = np.diff(np.append(begin, len(own_row)))
                other = count[at] - n_rare
                good = (other > 0) & (n_rare >= min_leaf) & (other >= min_leaf)
                if tried < width:
                    good &= allowed[at, by]
                if good.any():
                    rw, ry = np.add.reduceat(w[own_row], begin)[good], np.add.reduceat(wy[own_row], begin)[good]
                    at, by = at[good], by[good]
                    score = ry * ry / rw + (sy[at] - ry) ** 2 / (sw[at] - rw)
                    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    top = np.maximum.reduceat(score, heads)
                    hit = np.flatnonzero(score >= np.repeat(top - 1e-12 * np.abs(top), np.diff(np.append(heads, len(at)))))
                    where, first = np.unique(at[hit], return_index=True)  # of equal ones the first feature
                    first, slack = by[hit[first]], 1e-12 * np.where(np.isfinite(best[where]), np.abs(best[where]), 0)
                    better = (top > best[where] + slack) | (top >= best[where] - slack) & (first < best_f[where])
                    where, first = where[better], first[better]
                    best[where], best_f[where], best_c[where] = top[better], first, low[first]
            split = best_f >= 0
            np.add.at(gain, best_f[split], np.maximum(best[split] - sy[split] ** 2 / sw[split], 0))
            rank = np.cumsum(split) - 1
            feature[opened[split]] = best_f[split]
            code[opened[split]] = best_c[split]
            left[opened[split]] = base + k + 2 * rank[split]
            keep = split[node]
            rows, node = rows[keep], node[keep]
            goes_right = codes[rows, best_f[node]] > best_c[node]
            node = 2 * rank[node] + goes_right
            grown = 2 * int(split.sum())
        else:
            grown = 0
        for name, x in (("feature", feature), ("code", code), ("left", left), ("value", value), ("level", np.full(k, level, np.int16))):
            out[name].append(x)
        base, k, level = base + k, grown, level + 1
    return {name: np.concatenate(x) for name, x in out.items()} | {"gain": gain}


def leaf_of(tree: dict, codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Node of each row, at most ``depth`` levels down."""
    node = np.zeros(len(codes), np.int64)
    feature = tree["feature"] if depth is None else np.where(tree["level"] < depth, tree["feature"], -1)
    at, own = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    while len(at):
        f = feature[own]
        inner = f >= 0
        if not inner.all():
            node[at[~inner]] = own[~inner]
            at, own, f = at[inner], own[inner], f[inner]
        own = tree["left"][own] + (codes[at, f] > tree["code"][own])
    return node


def bag(uid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, from a hash."""
    x = uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD6E8FEB86659FD93 + seed * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    for shift in (30, 27, 31):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), "right").astype(float)


# ------------------------------------------------------------------ bins and blocks

def bin_edges(df: DataFrame, col: str, width: int) -> list[np.ndarray]:
    """Cut points of every feature, between neighbouring quantiles; one aggregation."""
    probs = [i / (BINS - 1) for i in range(BINS)]
    parts = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(col)[i]), F.col(col)[i]), probs, 20000).alias(f"q{i}") for i in range(width)]).first()
    out = []
    for q in parts:
        v = np.unique(np.array(q or [0.0], float))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def to_codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes of a matrix; missing values have the last code."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 255, np.searchsorted(e, x[:, f], "left"))
    return out


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _blocks(edges: list[np.ndarray]):
    """(uid, features, label, weight) rows to blocks of bin codes."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                uid, y, w = (np.asarray(part.column(i).to_numpy(zero_copy_only=False)) for i in (0, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (uid.astype(np.int64), to_codes(_matrix(part.column(1), len(edges)), edges),
                                                                    y.astype(float), w.astype(float))], names=["uid", "codes", "y", "w"])
    return run


def _open_block(row: dict, width: int):
    return (np.frombuffer(row["uid"], np.int64), np.frombuffer(row["codes"], np.uint8).reshape(-1, width),
            np.frombuffer(row["y"]), np.frombuffer(row["w"]))


def _block_rows(batches, width: int):
    for batch in batches:
        for j in range(batch.num_rows):
            yield _open_block(batch.slice(j, 1).to_pylist()[0], width)


# ------------------------------------------------------------------ growing

def _route(top: dict, codes: np.ndarray) -> np.ndarray:
    return leaf_of(top, codes) if len(top["feature"]) > 1 else np.zeros(len(codes), np.int64)


def _boxes(top: dict, nodes: list[int]) -> list[dict]:
    """For every 64 of ``nodes`` a table by feature: for each code, a bit per node whose path allows it."""
    parent = np.full(len(top["feature"]), -1)
    for i in np.flatnonzero(top["feature"] >= 0):
        parent[top["left"][i]] = parent[top["left"][i] + 1] = i
    out = []
    for i, node in enumerate(nodes):
        if i % 64 == 0:
            out.append({})
        tables, bit = out[-1], np.uint64(1 << i % 64)
        while parent[node] >= 0:
            above = parent[node]
            t = tables.setdefault(int(top["feature"][above]), np.full(256, ~np.uint64(0)))
            c = int(top["code"][above])
            if node == top["left"][above]:
                t[c + 1:] &= ~bit
            else:
                t[:c + 1] &= ~bit
            node = above
    return out


def _arrive(boxes: list[dict], n_nodes: int, codes: np.ndarray) -> np.ndarray:
    """The place among the nodes of ``boxes`` where each row arrives, -1: at none.  One look
    at a table per feature of the paths, however deep they are."""
    out = np.full(len(codes), -1)
    for g, tables in enumerate(boxes):
        k = min(64, n_nodes - 64 * g)
        bits = np.full(len(codes), ~np.uint64(0) >> np.uint64(64 - k))
        for f, t in tables.items():
            bits &= t[codes[:, f]]
        met = np.flatnonzero(bits)
        out[met] = 64 * g + (np.frexp(bits[met].astype(float))[1] - 1)  # paths exclude each other: a single bit
    return out


def _places(edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the sums of each feature begin, and the place of (feature, code) among
    them: a feature takes as many places as it has codes, the last for missing values."""
    starts = np.concatenate([[0], np.cumsum([len(e) + 2 for e in edges])]).astype(np.int64)
    place = np.empty((len(edges), 256), np.int64)
    for f, e in enumerate(edges):
        place[f] = starts[f] + np.minimum(np.arange(256), len(e) + 1)
    return starts, place


def _histograms(plan, edges: list[np.ndarray], seed: int):
    """Sums of the rows of every wanted node, combined over the task."""
    width = len(edges)
    starts, place = _places(edges)
    size = int(starts[-1])
    # of features with two codes at most, only the rows that have not the first are counted, the others are the rest of the node
    two = [f for f in range(width) if len(edges[f]) <= 1]
    many = [f for f in range(width) if len(edges[f]) > 1]
    few = np.concatenate([np.arange(starts[f], starts[f + 1]) for f in two] or [np.zeros(0, np.int64)])
    among = np.zeros(size, np.int64)
    among[few] = np.arange(len(few))

    def run(batches):
        tops, wanted = plan.value
        sums: dict = {}
        totals: dict = {}
        boxes = {tree: _boxes(tops[tree], nodes) for tree, nodes in wanted.items()}
        for uid, codes, y, w in _block_rows(batches, width):
            codes = np.asfortranarray(codes)  # read by feature
            at = {f: place[f][codes[:, f]] - starts[f] for f in many}
            row, j = np.nonzero(codes[:, two])  # by row
            each = np.bincount(row, minlength=len(codes))
            others = np.full((int(each.max(initial=0)), len(codes)), -1)
            others[np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each), row] = among[place[np.array(two, int)[j], codes[:, two][row, j]]]
            for tree, nodes in wanted.items():
                node = _arrive(boxes[tree], len(nodes), codes)
                own = np.flatnonzero(node >= 0)
                times = bag(uid[own], tree, seed)
                own, times = own[times > 0], times[times > 0]
                if not len(own):
                    continue
                h = sums.get(tree)
                if h is None:
                    h = sums[tree] = np.zeros((len(nodes), size, 4))
                    totals[tree] = np.zeros((len(nodes), 4))
                ww = w[own] * times
                wy = ww * y[own]
                node = node[own]
                for k, x in enumerate((None, ww, wy, wy * y[own])):
                    totals[tree][:, k] += np.bincount(node, x, len(nodes))
                parts = (None, ww, wy)  # squares are wanted of whole nodes only
                for f in many:
                    m = int(starts[f + 1] - starts[f])
                    key = node * m + at[f][own]
                    for k, x in enumerate(parts):
                        h[:, starts[f]:starts[f + 1], k] += np.bincount(key, x, len(nodes) * m).reshape(len(nodes), m)
                for p in others:
                    p = p[own]
                    met = p >= 0
                    key = node[met] * len(few) + p[met]
                    weights = (None, ww[met], wy[met])
                    if len(nodes) * len(few) <= 16 * len(own):
                        for k, x in enumerate(weights):
                            h[:, few, k] += np.bincount(key, x, len(nodes) * len(few)).reshape(len(nodes), len(few))
                    else:
                        keys, number = np.unique(key, return_inverse=True)
                        for k, x in enumerate(weights):
                            h[keys // len(few), few[keys % len(few)], k] += np.bincount(number, x, len(keys))
        for tree, h in sums.items():
            for f in two:
                h[:, starts[f], :3] = totals[tree][:, :3] - h[:, starts[f] + 1:starts[f + 1], :3].sum(axis=1)
            h[:, 0, 3] = totals[tree][:, 3]
            met = np.flatnonzero(h[:, :starts[1], 0].sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(met), tree, np.int32)), pa.array(np.array(wanted[tree])[met].astype(np.int32)),
                pa.array([h[i].tobytes() for i in met], pa.binary())], names=["tree", "node", "sums"])
    return run


def _choose(edges: list[np.ndarray], spec: dict, seed: int):
    """The best split of one node from its merged sums."""
    width = len(edges)
    starts, _ = _places(edges)
    last = starts[1:] - 1  # places of missing values
    inner = np.setdiff1d(np.arange(starts[-1]), last)  # a cut behind every other place
    of = np.searchsorted(starts, inner, "right") - 1

    def run(t: pa.Table) -> pa.Table:
        tree, node = t["tree"][0].as_py(), t["node"][0].as_py()
        h = sum(np.frombuffer(x, float).reshape(-1, 4) for x in t["sums"].to_pylist())
        total = h[:starts[1]].sum(axis=0)
        left = np.concatenate([np.cumsum(h[starts[f]:starts[f + 1]], axis=0)[:-1] for f in range(width)])
        right = total - left
        good = (left[..., 0] >= spec["min_leaf"]) & (right[..., 0] >= spec["min_leaf"])
        tried = min(spec["tried"] or width, width)
        if tried < width:
            draw = np.random.default_rng([seed, tree, node, 7]).random(width)
            good &= (draw <= np.partition(draw, tried - 1)[tried - 1])[of]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(good, left[..., 2] ** 2 / left[..., 1] + right[..., 2] ** 2 / right[..., 1], -np.inf)
        best = int(np.argmax(score))
        f, c = int(of[best]), int(inner[best] - starts[of[best]])
        flat = total[3] - total[2] ** 2 / total[1] <= 1e-9 * (1 + total[2] ** 2 / total[1])
        if flat or not np.isfinite(score[best]):
            f, n_left, won = -1, 0.0, 0.0
        else:
            n_left, won = left[best, 0], max(score[best] - total[2] ** 2 / total[1], 0)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([int(f)], pa.int32()),
                         "code": pa.array([int(c)], pa.int32()), "n": pa.array([int(total[0])], pa.int64()),
                         "n_left": pa.array([int(n_left)], pa.int64()), "value": pa.array([float(total[2] / total[1])]),
                         "gain": pa.array([float(won)])})
    return run


def _deal(plan, width: int, seed: int):
    """The drawn rows of every node that is finished in one task."""
    names = ["tree", "node", "n", "codes", "y", "w"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        tops, closed = plan.value
        for uid, codes, y, w in _block_rows(batches, width):
            out, size = [], 0
            for tree, top in tops.items():
                times = bag(uid, tree, seed)
                drawn = np.flatnonzero(times > 0)
                where = np.zeros(len(codes), np.int64)
                where[drawn] = _route(top, codes[drawn])
                for node, own in _by_node(where, drawn):
                    if (tree, node) in closed:
                        continue
                    out.append((tree, node, len(own), codes[own].tobytes(), y[own].tobytes(), (w[own] * times[own]).tobytes()))
                    size += len(own) * (width + 16)
                if size > BATCH_BYTES:
                    yield _batch(out, names, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, names, kinds)
    return run


def _by_node(where: np.ndarray, own: np.ndarray):
    """(node, its rows among ``own`` in their order)."""
    order = own[np.argsort(where[own], kind="stable")]
    at = where[order]
    ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1 if len(at) else []
    begin = 0
    for end in ends:
        yield int(at[begin]), order[begin:end]
        begin = end


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], names=names)


_MODEL = "tree int, node int, feature binary, code binary, left binary, value binary, level binary, gain binary"
_KINDS = {"feature": np.int16, "code": np.uint8, "left": np.int32, "value": np.float64, "level": np.int16}


def _finish(plan, width: int, spec: dict, seed: int):
    """The subtree of one node."""
    def run(t: pa.Table) -> pa.Table:
        tree, node = t["tree"][0].as_py(), t["node"][0].as_py()
        codes = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, width) for x in t["codes"].to_pylist()])
        y, w = (np.concatenate([np.frombuffer(x) for x in t[c].to_pylist()]) for c in ("y", "w"))
        level = int(plan.value[0][tree]["level"][node])
        grown = grow_tree(codes, y, w, [seed, tree, node], spec["depth"], spec["min_leaf"], spec["min_split"], spec["tried"], level)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{k: pa.array([grown[k].astype(kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()},
                         "gain": pa.array([grown["gain"].tobytes()], pa.binary())})
    return run


def _join_trees(top: dict, rows: list[dict]) -> dict:
    """One tree from its upper part and the subtrees below it."""
    parts = {k: [top[k].astype(kind)] for k, kind in _KINDS.items()}
    size = len(top["feature"])
    for r in rows:
        own = {k: np.frombuffer(r[k], kind) for k, kind in _KINDS.items()}
        left = np.where(own["left"] >= 0, own["left"] - 1 + size, -1).astype(np.int32)
        at = r["node"]  # the subtree's root takes the place of the node
        for k in _KINDS:
            parts[k][0][at] = left[0] if k == "left" else own[k][0]
            parts[k].append(left[1:] if k == "left" else own[k][1:])
        size += len(own["feature"]) - 1
    return {k: np.concatenate(v) for k, v in parts.items()}


def _score_blocks(edges: list[np.ndarray]):
    """(row, features) rows to numbered blocks of bin codes."""
    width = len(edges)

    def run(batches):
        task, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number], pa.int64()), pa.array([np.concatenate([r for r, _ in held]).tobytes()], pa.binary()),
                 pa.array([np.concatenate([c for _, c in held]).tobytes()], pa.binary())], names=["block", "row", "codes"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                held.append((part.column(0).to_numpy().astype(np.int64), to_codes(_matrix(part.column(1), width), edges)))
                n += part.num_rows
                if n >= SCORE_BLOCK_ROWS:
                    yield block()
                    number, held, n = number + 1, [], 0
        if n:
            yield block()
    return run


def _routed(plan, width: int):
    """The rows of every block, by the node of the upper part where they arrive."""
    names, kinds = ["tree", "node", "part", "block", "at", "codes"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        tops, parts = plan.value
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, width)
                out, size = [], 0
                for tree, top in tops.items():
                    for node, own in _by_node(_route(top, codes), np.arange(len(codes))):
                        part = (r["block"] ^ r["block"] >> 32) % parts.get((tree, node), 1)
                        out.append((tree, node, part, r["block"], own.astype(np.int32).tobytes(), codes[own].tobytes()))
                        size += len(own) * (width + 4)
                    if size > BATCH_BYTES:
                        yield _batch(out, names, kinds)
                        out, size = [], 0
                if out:
                    yield _batch(out, names, kinds)
    return run


def _arrivals(plan, width: int):
    """How many rows of each block arrive at every node."""
    def run(batches):
        tops, _ = plan.value
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, width)
                rows = [(tree, node, len(own)) for tree, top in tops.items() for node, own in _by_node(_route(top, codes), np.arange(len(codes)))]
                yield _batch(rows, ["tree", "node", "n"], [pa.int32(), pa.int32(), pa.int64()])
    return run


def _apply_subtree(plan, width: int, depths=(None,)):
    """Values of the rows that arrived at one node, from the subtree below it; for several
    ``depths`` one after another."""
    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        values = []
        tree = None
        if model.num_rows:
            tree = {k: np.frombuffer(model[k][0].as_py(), kind) for k, kind in _KINDS.items()}
        for r in rows.select(["tree", "node", "codes"]).to_pylist():
            codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, width)
            top = plan.value[0][r["tree"]]
            out = []
            for d in depths:
                if tree is None or d is not None and d < top["level"][r["node"]]:  # a leaf of the upper part, or cut off there
                    out.append(top["value"][leaf_of(top, codes, d)].astype(float))
                else:
                    out.append(tree["value"][leaf_of(tree, codes, d)])
            values.append(np.concatenate(out).tobytes())
        return pa.table({"block": rows["block"].cast(pa.int64()), "tree": rows["tree"].cast(pa.int32()), "at": rows["at"].cast(pa.binary()),
                         "value": pa.array(values, pa.binary())})
    return run


def _gather(trees: list[int], each: bool):
    """The values of a block's rows by all trees, in their order, or the mean of them."""
    number = {t: i for i, t in enumerate(trees)}

    def run(values: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({"_row": pa.array([], pa.int64()), "_value": pa.array([], pa.list_(pa.float64()) if each else pa.float64())})
        ids = np.frombuffer(blocks["row"][0].as_py(), np.int64)
        got = np.zeros((len(trees), len(ids)))
        for tree, at, value in zip(values["tree"].to_pylist(), values["at"].to_pylist(), values["value"].to_pylist()):
            got[number[tree], np.frombuffer(at, np.int32)] = np.frombuffer(value)
        if each:
            flat = pa.array(np.ascontiguousarray(got.T).ravel())
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(trees), pa.int32()), flat)
        else:
            total = np.zeros(len(ids))
            for v in got:  # one by one, as the aggregate over an array adds them
                total += v
            out = pa.array(total / len(trees))
        return pa.table({"_row": pa.array(ids), "_value": out})
    return run


def _gather_points(points: list[tuple], depths: list):
    """For the rows of a block the mean over the first trees, for every (trees, depth) of ``points``."""
    def run(values: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({"_row": pa.array([], pa.int64()), "_value": pa.array([], pa.list_(pa.float64()))})
        ids = np.frombuffer(blocks["row"][0].as_py(), np.int64)
        got = np.zeros((len(points), len(ids)))
        trees = values["tree"].to_numpy()
        for j in np.argsort(trees, kind="stable"):  # added in the order of the trees
            at = np.frombuffer(values["at"][int(j)].as_py(), np.int32)
            v = np.frombuffer(values["value"][int(j)].as_py()).reshape(len(depths), -1)
            for i, (n, d) in enumerate(points):
                if trees[j] < n:
                    got[i, at] += v[depths.index(d)]
        got /= np.array([n for n, _ in points], float)[:, None]
        flat = pa.array(np.ascontiguousarray(got.T).ravel())
        return pa.table({"_row": pa.array(ids), "_value": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(points), pa.int32()), flat)})
    return run


class Forest:
    """A grown forest: its model table, the upper parts of the trees and the cut points."""

    def __init__(self, table: DataFrame, tops: dict, edges: list[np.ndarray], gains: dict):
        self.table, self.tops, self.edges, self.gains = table, tops, edges, gains

    def size(self) -> int:
        """About how many bytes all subtrees take."""
        return self.table.agg(F.coalesce(F.sum(F.octet_length("value") * 3), F.lit(0))).first()[0]

    def groups(self):
        """Trees in groups of about ``MODEL_BYTES``, each fetched when it is needed."""
        size = {r.tree: r.b for r in self.table.groupBy("tree").agg(F.sum(F.octet_length("value") * 3).alias("b")).collect()}
        group, total = [], 0
        for tree in sorted(self.tops):
            if group and total + size.get(tree, 0) > MODEL_BYTES:
                yield self._fetch(group)
                group, total = [], 0
            group.append(tree)
            total += size.get(tree, 0)
        yield self._fetch(group)

    def _fetch(self, trees: list[int]) -> list[dict]:
        rows: dict = {}
        for r in self.table.where(F.col("tree").isin(trees)).drop("gain").collect():
            rows.setdefault(r.tree, []).append(r.asDict())
        return [_join_trees(self.tops[t], sorted(rows.get(t, []), key=lambda r: r["node"])) for t in trees]

    def tree_values(self, df: DataFrame, col: str, out: str = "tree_values") -> DataFrame:
        """``out``: the prediction of every tree for the features in ``col`` (array of doubles)."""
        if self.size() <= MODEL_BYTES:
            return self._sent(df, col, out)
        rows = reliable_checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
        return rows.join(self.row_values(rows, col, each=True).withColumnRenamed("_value", out), "_row").drop("_row")

    def mean_values(self, df: DataFrame, col: str, out: str) -> DataFrame:
        """``out``: the mean prediction of the trees, of a forest of at most ``MODEL_BYTES``.
        A task holds one number a row, not one a row and tree."""
        edges = self.edges
        trees = df.sparkSession.sparkContext.broadcast(self._fetch(sorted(self.tops)))

        @F.pandas_udf("double")
        def mean(x):
            import pandas as pd
            total = np.zeros(len(x))
            if len(x):
                codes = to_codes(np.stack(x.to_numpy()).astype(float), edges)
                for t in trees.value:  # one by one, as the aggregate over an array adds them
                    total += t["value"][leaf_of(t, codes)]
            return pd.Series(total / len(trees.value))

        return df.withColumn(out, mean(F.col(col)))

    def point_values(self, df: DataFrame, col: str, points: list[tuple]) -> DataFrame:
        """(``_row``, ``_value``): for every (trees, depth) of ``points`` the mean over the first
        trees, cut at the depth (None: not cut); ``_row`` is a unique number."""
        depths = list(dict.fromkeys(d for _, d in points))
        if self.size() > MODEL_BYTES:
            return self.row_values(df, col, True, points)
        edges = self.edges
        trees = df.sparkSession.sparkContext.broadcast(self._fetch(sorted(self.tops)))

        @F.pandas_udf("array<double>")
        def means(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=object)
            codes = to_codes(np.stack(x.to_numpy()).astype(float), edges)
            got = np.zeros((len(points), len(x)))
            for tree, t in enumerate(trees.value):
                v = {d: t["value"][leaf_of(t, codes, d)] for d in depths}
                for i, (n, d) in enumerate(points):
                    if tree < n:
                        got[i] += v[d]
            return pd.Series(list((got / np.array([n for n, _ in points], float)[:, None]).T))

        return df.select("_row", means(F.col(col)).alias("_value"))

    def _sent(self, df: DataFrame, col: str, out: str) -> DataFrame:
        edges = self.edges
        trees = df.sparkSession.sparkContext.broadcast(self._fetch(sorted(self.tops)))

        @F.pandas_udf("array<double>")
        def values(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=object)
            codes = to_codes(np.stack(x.to_numpy()).astype(float), edges)
            return pd.Series(list(np.stack([t["value"][leaf_of(t, codes)] for t in trees.value], axis=1)))

        return df.withColumn(out, values(F.col(col)))

    def row_values(self, df: DataFrame, col: str, each: bool, points: list[tuple] | None = None) -> DataFrame:
        """(``_row``, ``_value``): the predictions of every tree (``each``) or their mean,
        for the features in ``col``, or the means of ``point_values``; ``_row`` is a unique
        number.  The trees stay where they are."""
        depths = list(dict.fromkeys(d for _, d in points)) if points else [None]
        width, context = len(self.edges), df.sparkSession.sparkContext
        blocks = reliable_checkpoint(df.select("_row", F.col(col).alias("x")).mapInArrow(_score_blocks(self.edges), "block long, row binary, codes binary"))
        # a node that many rows reach is dealt to several tasks, its subtree to each
        came = blocks.mapInArrow(_arrivals(context.broadcast((self.tops, {})), width), "tree int, node int, n long")
        parts = {(r.tree, r.node): r.parts for r in came.groupBy("tree", "node").agg(F.ceil(F.sum("n") / SCORE_ROWS).cast("int").alias("parts"))
                                                       .where("parts > 1").collect()}
        plan = context.broadcast((self.tops, parts))
        rows = blocks.mapInArrow(_routed(plan, width), "tree int, node int, part int, block long, at binary, codes binary")
        several = df.sparkSession.createDataFrame([(*k, v) for k, v in parts.items()], "tree int, node int, parts int")
        model = self.table.drop("gain").join(F.broadcast(several), ["tree", "node"], "left") \
                    .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        values = rows.groupBy("tree", "node", "part").cogroup(model.groupBy("tree", "node", "part")).applyInArrow(
            _apply_subtree(plan, width, depths), "block long, tree int, at binary, value binary")
        kind = "array<double>" if each else "double"
        return values.groupBy("block").cogroup(blocks.select("block", "row").groupBy("block")).applyInArrow(
            _gather_points(points, depths) if points else _gather(sorted(self.tops), each), f"_row long, _value {kind}")

    def importances(self) -> np.ndarray:
        """Share of the impurity decrease per feature, mean over the trees."""
        each = {t: self.gains[t].copy() for t in self.tops}
        for r in self.table.select("tree", "gain").toLocalIterator():
            each[r.tree] += np.frombuffer(r.gain)
        shares = [g / g.sum() for g in each.values() if g.sum() > 0]
        return np.mean(shares, axis=0) if shares else np.zeros(len(self.edges))


def grow_forest(df: DataFrame, key: str, col: str, label: str, trees: int = 100, weight: str | None = None, depth: int | None = None,
                min_leaf: int = 1, min_split: int = 2, tried: str = "all", seed: int = 42, edges: list[np.ndarray] | None = None) -> Forest:
    """A forest over the features in ``col`` (array of doubles); ``key`` is a unique
    column.  ``depth`` None: until the leaves are pure or too small; ``tried``:
    features looked at in a split, all or sqrt; ``edges``: cut points, else those of the rows."""
    first = df.select(F.size(col).alias("n")).first()
    if first is None:
        raise ValueError("no rows to grow a forest on")
    width = first.n
    spec = {"depth": depth if depth is not None else 1 << 30, "min_leaf": min_leaf, "min_split": min_split,
            "tried": max(1, int(math.sqrt(width))) if tried == "sqrt" else None}
    edges = bin_edges(df, col, width) if edges is None else edges
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    blocks = reliable_checkpoint(df.select(F.xxhash64(key).alias("uid"), F.col(col).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
                                   .mapInArrow(_blocks(edges), "uid binary, codes binary, y binary, w binary"))
    rows = blocks.agg(F.sum(F.octet_length("uid") / 8)).first()[0]
    context = df.sparkSession.sparkContext
    tops = {t: {"feature": np.array([-1]), "code": np.array([0]), "left": np.array([-1]), "value": np.array([0.0]), "level": np.array([0])}
            for t in range(trees)}
    gains = {t: np.zeros(width) for t in range(trees)}
    closed: set = set()
    large = [(t, 0) for t in range(trees)] if rows > LOCAL_ROWS else []
    # the sums of a wave, 32 bytes a place, are held by every task
    at_once = max(1, min(NODES_AT_ONCE, HISTOGRAM_BYTES // (32 * sum(len(e) + 2 for e in edges))))
    while large:
        wave, large = large[:at_once], large[at_once:]
        wanted: dict = {}
        for t, node in wave:
            wanted.setdefault(t, []).append(node)
        plan = context.broadcast((tops, wanted))
        sums = blocks.mapInArrow(_histograms(plan, edges, seed), "tree int, node int, sums binary")
        splits = sums.groupBy("tree", "node").applyInArrow(_choose(edges, spec, seed), "tree int, node int, feature int, code int, n long, "
                                                           "n_left long, value double, gain double").collect()  # a row per node of the wave
        for s in sorted(splits, key=lambda s: (s.tree, s.node)):
            top = tops[s.tree]
            top["value"][s.node] = s.value
            if s.feature < 0 or top["level"][s.node] >= spec["depth"] or s.n < min_split:
                closed.add((s.tree, s.node))
                continue
            gains[s.tree][s.feature] += s.gain
            child = len(top["feature"])
            top["feature"][s.node], top["code"][s.node], top["left"][s.node] = s.feature, s.code, child
            for k, v in (("feature", -1), ("code", 0), ("left", -1), ("value", s.value), ("level", top["level"][s.node] + 1)):
                top[k] = np.append(top[k], [v, v])
            large += [(s.tree, child + i) for i, n in enumerate((s.n_left, s.n - s.n_left)) if n > LOCAL_ROWS]
    plan = context.broadcast((tops, closed))
    dealt = blocks.mapInArrow(_deal(plan, width, seed), "tree int, node int, n long, codes binary, y binary, w binary")
    table = reliable_checkpoint(dealt.repartition("tree", "node").groupBy("tree", "node").applyInArrow(_finish(plan, width, spec, seed), _MODEL))
    return Forest(table, tops, edges, gains)


# ------------------------------------------------------------------ searching

def boost(codes, y, held, rounds, step: float, depth: int, share: float, seed) -> dict[int, np.ndarray]:
    """Logistic boosting on (codes, y): scores of ``held`` after each of ``rounds``."""
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    raw, far = np.full(len(y), math.log(p / (1 - p))), np.full(len(held), math.log(p / (1 - p)))
    out = {}
    for r in range(max(rounds)):
        prob = 1 / (1 + np.exp(-raw))
        own = np.arange(len(y))
        if share < 1:
            own = np.flatnonzero(np.random.default_rng([*seed, r]).random(len(y)) < share)
            own = own if len(own) else np.arange(len(y))
        tree = grow_tree(codes[own], (y - prob)[own], np.ones(len(own)), [*seed, r], depth)
        leaf = leaf_of(tree, codes)
        size = len(tree["feature"])
        top = np.bincount(leaf[own], (y - prob)[own], size)
        low = np.bincount(leaf[own], (prob * (1 - prob))[own], size)
        value = top / np.maximum(low, 1e-12)
        raw = raw + step * value[leaf]
        far = far + step * value[leaf_of(tree, held)]
        if r + 1 in rounds:
            out[r + 1] = far
    return out


def logistic(x, y, w, strength: float, l1_share: float, rounds: int = 1000) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of a logistic regression with an elastic net, by
    accelerated proximal gradient steps until nothing moves any more."""
    w = w / w.sum()
    step = 1 / (0.25 * np.linalg.norm((x * w[:, None]).T @ x, 2) + 0.25 + strength * (1 - l1_share))
    coef = at = np.zeros(x.shape[1] + 1)  # the last one is the intercept
    t = 1.0
    for _ in range(rounds):
        wrong = w * (1 / (1 + np.exp(-np.clip(x @ at[:-1] + at[-1], -500, 500))) - y)
        new = at - step * np.append(x.T @ wrong + strength * (1 - l1_share) * at[:-1], wrong.sum())
        cut = step * strength * l1_share
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - cut, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        at, moved = new + (before - 1) / t * (new - coef), np.abs(new - coef).max()
        coef = new
        if moved < 1e-7:
            break
    return float(coef[-1]), coef[:-1]


def _fits(kind: str, grid: dict) -> list[tuple[dict, list[tuple[int, dict]]]]:
    """Grid points grouped by the fit that serves them: (fit, [(number of the point, point)])."""
    shared = {"random_forest": ("trees", "depth"), "gradient_boosting": ("rounds",), "logistic_regression": ()}[kind]
    fits: dict = {}
    for i, values in enumerate(product(*grid.values())):
        point = dict(zip(grid, values))
        fits.setdefault(tuple((k, v) for k, v in point.items() if k not in shared), []).append((i, point))
    return [(dict(k), v) for k, v in fits.items()]


def _run_unit(kind: str, fit: dict, points: list, tree_range, sample, fold: int, seed: int):
    """(point, row, value) of the held-out rows; forests give sums over their trees."""
    uid, codes, y, w, folds = sample
    own, out = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
    if kind == "logistic_regression":  # here ``codes`` are the features
        b, coef = logistic(codes[own], y[own], w[own], 1 / (fit["C"] * max(len(own), 1)), fit.get("elasticNetParam", 0.0))
        return [(i, out, codes[out] @ coef + b) for i, _ in points]
    if kind == "gradient_boosting":
        by = boost(codes[own], y[own], codes[out], {p["rounds"] for _, p in points}, fit["step"], fit["depth"], fit["share"], [seed, fold])
        return [(i, out, by[p["rounds"]]) for i, p in points]
    sums = {i: np.zeros(len(out)) for i, _ in points}
    tried = max(1, int(math.sqrt(codes.shape[1])))
    for tree in tree_range:
        times = bag(uid[own], tree, seed)
        drawn = own[times > 0]
        if not len(drawn):
            continue
        depths = [p.get("depth") for _, p in points]
        deepest = None if None in depths else max(depths)
        grown = grow_tree(codes[drawn], y[drawn], w[drawn] * times[times > 0], [seed, tree, fold], 1 << 30 if deepest is None else deepest,
                          fit.get("min_leaf", 1), fit.get("min_split", 2), tried)
        values = {d: grown["value"][leaf_of(grown, codes[out], d)] for d in set(depths)}
        for i, p in points:
            if tree < p["trees"]:
                sums[i] += values[p.get("depth")] / p["trees"]
    return [(i, out, s) for i, s in sums.items()]


def draw_sample(df: DataFrame, key: str, col: str, label: str, weight: str | None, folds: int, rows: int | None = None):
    """At most ``rows`` rows by a hash of the key: (uid, features, label, weight, fold), folds dealt within each label."""
    rows = rows or SEARCH_ROWS
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = df.select(F.xxhash64(key).alias("uid"), F.col(col).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    total = x.count()
    if total > rows:  # a share by hash first, so that few rows meet in the sort
        x = x.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < min(1 << 20, int(1.3 * rows * (1 << 20) / total) + 64))
    got = x.orderBy(F.xxhash64("uid")).limit(rows).collect()
    uid, y, w = (np.array([r[i] for r in got]) for i in (0, 2, 3))
    fold = np.zeros(len(got), np.int64)
    for v in np.unique(y):
        own = np.flatnonzero(y == v)
        fold[own] = np.arange(len(own)) % folds
    return uid.astype(np.int64), np.array([r[1] for r in got], float), y.astype(float), w.astype(float), fold


def best_point(spark, kind: str, grid: dict, sample, folds: int, metric: str = "auc", seed: int = 42) -> tuple[dict, DataFrame]:
    """The best point of ``grid`` by the mean of ``metric`` (auc or f1) over the folds, and the
    table (point, score).  Forest grids have trees, depth (None: no limit), min_leaf and min_split,
    boosting grids rounds, step, depth and share, logistic grids C and elasticNetParam."""
    uid, x, y, w, fold = sample
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS), method="nearest"))
        edges.append((v[1:] + v[:-1]) / 2)
    shared = spark.sparkContext.broadcast((uid, x if kind == "logistic_regression" else to_codes(x, edges), y, w, fold))
    units = []
    for fit, points in _fits(kind, grid):
        trees = max((p.get("trees", 1) for _, p in points))
        batches = [range(a, min(a + BATCH_TREES, trees)) for a in range(0, trees, BATCH_TREES)] if kind == "random_forest" else [None]
        units += [(fit, points, b, k) for b in batches for k in range(folds)]

    def run(batches):
        for batch in batches:
            for u in batch.column(0).to_pylist():
                fit, points, trees, k = units[u]
                for i, rows, values in _run_unit(kind, fit, points, trees, shared.value, k, seed):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), i, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(rows.astype(np.int32)),
                        pa.array(shared.value[2][rows].astype(np.int32)), pa.array(values)], names=["point", "fold", "row", "y", "value"])

    work = spark.range(0, len(units), 1, len(units)).mapInArrow(run, "point int, fold int, row int, y int, value double")
    scored = reliable_checkpoint(work.groupBy("point", "fold", "row", "y").agg(F.sum("value").alias("value")))
    return pick_point(kind, grid, scored, metric)


def pick_point(kind: str, grid: dict, scored: DataFrame, metric: str) -> tuple[dict, DataFrame]:
    """The best point by the mean of ``metric`` over the folds, and the table (point, score), from
    written scores (point, fold, row, y, value) of held-out rows."""
    if metric == "auc":
        each = stats.roc_auc(scored, "y", "value", by=["point", "fold"]).select("point", "fold", F.coalesce("auc", F.lit(0.5)).alias("m"))
    else:
        cut = 0.5 if kind == "random_forest" else 0.0
        each = stats.classification_metrics(scored.withColumn("_p", (F.col("value") >= cut).cast("int")), "y", "_p", by=["point", "fold"])
        each = each.select("point", "fold", F.col("f1").alias("m"))
    table = reliable_checkpoint(each.groupBy("point").agg(F.avg("m").alias("score")))
    best = table.orderBy(F.desc("score"), "point").first().point
    return dict(zip(grid, list(product(*grid.values()))[best])), table
