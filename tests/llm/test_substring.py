"""Exact substring dedup against brute force."""
import random

import numpy as np
import pytest

from ledgerline.llm import substring as sub
from ledgerline.llm.common import prepare


def brute(rows, width=50):
    """(id, n_bytes, spans, kept) by definition."""
    big = lambda i: 1 << 63 if i is None else i
    owner = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raws:
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            owner[w] = min(owner.get(w, 1 << 64), big(i))
    out = []
    for i, b in raws:
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if owner[b[p:p + width]] < big(i):
                gone[p:p + width] = [True] * width
        spans, p = [], 0
        while p < len(b):
            if gone[p]:
                q = p
                while q < len(b) and gone[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus(rng):
    vocab = ["the", "tion", "é", "in", "of", "a", "ж", "0", "\0", "licence"]
    para = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [para(rng.randint(5, 60)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [para(rng.randint(0, 40)) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((rng.randint(0, 400), "\n".join(parts)))
    rows += [(i + 500, rows[i][1]) for i in range(25)] + [(7, rows[3][1]), rows[9], rows[9]]
    rows += [(900, None), (901, ""), (902, "x" * 49), (903, "x" * 50), (904, "x" * 300), (905, "ab" * 200), (906, "z" + "ab" * 100)]
    rows += [(None, shared[0]), (None, shared[0] + "tail"), (950, para(4000)), (951, None)]
    rng.shuffle(rows)
    return rows


def test_minimizers_and_index():
    rng = random.Random(10)
    data = bytes(rng.choice(b"ab ") for _ in range(70_000))
    m = sub.minimizers(data)
    seen = {}
    for p in range(len(m)):
        assert seen.setdefault(data[p:p + 50], m[p]) == m[p]
    for text in (data[:3000], b"a" * 500, bytes(rng.choice(b"abcdefgh\0\xff") for _ in range(2000)) * 3, b"x" * 50, b"abc"):
        order, ends = sub.lcp_groups(text)
        pad = text + b"\0" * 64
        group = np.empty(len(text) + 1, np.int64)
        group[order] = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        names = {}
        for p in range(len(text) + 1):
            assert names.setdefault(pad[p:p + 50], group[p]) == group[p]
        assert len(names) == len(ends) - 1


@pytest.mark.parametrize("chunk,slice_,hot", [(2 << 20, 1 << 20, 1024), (3000, 2000, 1024), (1500, 500, 3)])
def test_matches_brute_force(spark, monkeypatch, chunk, slice_, hot):
    prepare(spark)
    rows = corpus(random.Random(11))
    # the workers import the module anew: parameters travel inside the functions' globals only in this process
    monkeypatch.setattr(sub, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(sub, "SLICE_BYTES", slice_)
    monkeypatch.setattr(sub, "HOT_CHUNKS", hot)
    if chunk == 2 << 20:
        df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, spans string").repartition(5)
        got = [(r.id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in sub.remove_repeats(df).collect()]
    else:
        got = local(rows)
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def local(rows, buckets=7):
    """The stages of remove_repeats without Spark, for small limits."""
    import pyarrow as pa
    from unittest import mock

    class Task:
        @staticmethod
        def get():
            return mock.Mock(partitionId=lambda: 1)
    with mock.patch("pyspark.TaskContext", Task):
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["id", "text"])
        packed = [r for b in sub._pack([batch]) for r in b.to_pylist()]
    assert len(packed) > 3

    def grouped(emitted, fn):
        out, by = {}, {}
        for b in emitted:
            for r in b.to_pylist():
                by.setdefault(r["bucket"], []).append(r)
        for own in by.values():
            for r in fn(pa.Table.from_pylist(own)).to_pylist():
                out.setdefault(r["chunk"], []).append(r)
        return out
    batches = lambda extra: [pa.RecordBatch.from_pylist([{**p, **{k: v.get(p["chunk"]) for k, v in extra.items()}}]) for p in packed]
    flags = grouped(sub._emit_anchors(buckets)(batches({})), sub._find_shared)
    verdicts = grouped(sub._emit_runs(buckets)(batches({"flags": flags})), sub._judge_bucket)
    out = []
    for b in sub._cut(buckets)(batches({"flags": flags, "verdicts": verdicts})):
        out += [(r["id"], r["n_bytes"], [(s["begin"], s["end"]) for s in r["spans"]], r["kept"]) for r in b.to_pylist()]
    return out


def test_empty(spark):
    prepare(spark)
    assert sub.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
