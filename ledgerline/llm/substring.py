"""Exact substring dedup: threshold-bounded interval expansion on a BWT.

A byte is removed if it is covered by a ``WIDTH``-byte string of its document
that also starts in a document with a smaller id.

1. *Pack.*  Documents are packed into compressed chunks of about
   ``CHUNK_BYTES``, written once; chunks are the unit of the later passes.
2. *Route.*  Every window of ``WIDTH`` bytes is routed by its minimizer, the
   least hash of its ``GRAM``-byte grams: equal windows have equal minimizers,
   and neighbouring windows mostly share one, so they travel as one run.
   Chunks send their distinct minimizers to hash buckets; only windows whose
   minimizer occurs in two or more documents go on.  (Nothing is lost: a
   shared window shares its minimizer.)  A minimizer found in more than
   ``HOT_CHUNKS`` chunks does not route: its windows go one by one, by the
   hash of the whole window.
3. *Index.*  Chunks send the distinct byte runs of those windows with their
   smallest id.  A bucket joins equal runs, sorts the suffixes of the others
   (64 bytes deep, which fixes all intervals up to ``WIDTH``), forms their
   Burrows-Wheeler transform and derives the longest common prefixes in
   increasing order: an interval of an l-byte string is extended backward by
   every preceding byte, and where the end of the extended interval has no
   value yet it gets l and the interval is queued for l + 1.  The expansion
   stops at ``WIDTH``; ends without a value separate nothing, so the rows
   between set ends are the groups of equal windows, and each group's smallest
   id owns the window.  (Values below eight are read off the first sort words.)
4. *Cut.*  Verdicts return to the chunks, which mark the covered bytes.

Defined cases: a null text is empty; a null id counts as larger than every
id; equal ids do not remove from each other; repeated rows are rows; an empty
table gives an empty result; other columns are not kept.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import as_bytes
from ledgerline.session import reliable_checkpoint, shuffle_partitions

WIDTH, GRAM = 50, 16
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 32 << 20  # of text, for the number of buckets
SLICE_BYTES = 1 << 19  # of distinct runs, for one index
ROWS = 8192  # taken out of arrays at a time
PIECE = 1 << 18  # rows of the transform looked at together
HOT_CHUNKS = 1024
NULL_ID = (1 << 63) - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def words_at(data: bytes, order: str) -> np.ndarray:
    """The 8-byte word (``<`` or ``>``) at every offset; ``data`` has 8 spare bytes."""
    n = len(data) - 8
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        k = (n - o + 7) // 8
        out[o::8] = np.frombuffer(data, order + "u8", k, o)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _C[1]
    x ^= x >> np.uint64(32)
    return x


def minimizers(data: bytes) -> np.ndarray:
    """Least gram hash of the window at every offset (len - WIDTH + 1 of them)."""
    n = len(data) - WIDTH + 1
    out = np.empty(max(n, 0), np.uint64)
    step = 1 << 15  # pieces that stay in the processor cache
    span = WIDTH - GRAM + 1
    for at in range(0, n, step):
        k = min(step, n - at)
        w = words_at(data[at:at + k + WIDTH - 1] + b"\0" * 8, "<")[:k + WIDTH - 8]
        m = _mix(w[:k + span - 1] * _C[0] + w[8:8 + k + span - 1] * _C[2])
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[:width - span], m[span - width:])
        out[at:at + k] = m[:k]
    return out


def flag_bits(uniq: np.ndarray, flags: list[dict], buckets: int, name: str) -> np.ndarray:
    """The bits ``name`` of all buckets, one per distinct route."""
    bits = np.zeros(len(uniq), bool)
    edges = np.searchsorted(bucket_of(uniq, buckets), np.arange(buckets + 1))
    for f in flags:
        lo, hi = edges[f["bucket"]], edges[f["bucket"] + 1]
        bits[lo:hi] = np.unpackbits(np.frombuffer(f[name], np.uint8), count=hi - lo).astype(bool)
    return bits


def bucket_of(route: np.ndarray, buckets: int) -> np.ndarray:
    return ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """One packed chunk: ids, byte offsets, data and its runs of windows."""

    def __init__(self, ids: bytes, offsets: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(data) if data else b""
        m = minimizers(self.data)
        self.start = np.zeros(0, np.int64)
        if not len(m):
            self.doc = self.count = self.start
            self.route = m
            return
        good = np.ones(len(m), bool)  # windows inside one document
        for k in range(1, WIDTH):
            at = self.offsets[1:-1] - k
            good[at[(at >= 0) & (at < len(m))]] = False
        change = np.ones(len(m), bool)
        change[1:] = (m[1:] != m[:-1]) | ~good[:-1]
        inner = self.offsets[1:-1]
        change[inner[inner < len(m)]] = True
        self.start = np.flatnonzero(change & good)
        ends = np.flatnonzero(change | ~good)
        stop = np.append(ends, len(m))[np.searchsorted(ends, self.start, "right")]
        self.count = stop - self.start
        # documents without bytes share an offset with the next; the search finds the last, which has bytes
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        # minima crowd at the low end of their range: mixed anew they fill the buckets evenly
        self.route = _mix(m[self.start] * _C[0])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers, whether several ids have each, and the number of each run."""
        uniq, inv = np.unique(self.route, return_inverse=True)
        ids = self.ids[self.doc]
        low = np.full(len(uniq), NULL_ID)
        high = np.full(len(uniq), np.iinfo(np.int64).min)
        np.minimum.at(low, inv, ids)
        np.maximum.at(high, inv, ids)
        return uniq, low != high, inv

    def runs(self, flags: list[dict], buckets: int):
        """Distinct byte runs that may be shared: (routes, smallest ids, contents,
        occurrences), in bucket order.  Occurrence: (run, start, windows, id)."""
        uniq, _, inv = self.anchors()
        shared, hot = (flag_bits(uniq, flags, buckets, name) for name in ("shared", "hot"))
        start, count, doc, route = (x[shared[inv] & ~hot[inv]] for x in (self.start, self.count, self.doc, self.route))
        burning = np.flatnonzero(shared[inv] & hot[inv])
        if len(burning):  # windows one by one, routed by a hash of all their bytes
            n = self.count[burning]
            at = np.repeat(self.start[burning] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            words = words_at(self.data + b"\0" * 8, "<")
            h = np.zeros(len(at), np.uint64)
            for k in (*range(0, WIDTH - 8, 8), WIDTH - 8):
                h = _mix((h ^ words[at + k]) * _C[0] + _C[2])
            start, count = np.concatenate([start, at]), np.concatenate([count, np.ones(len(at), np.int64)])
            doc, route = np.concatenate([doc, np.repeat(self.doc[burning], n)]), np.concatenate([route, h])
        order = np.argsort(route, kind="stable")
        start, count, doc, route = start[order], count[order], doc[order], route[order]
        ids = self.ids[doc]
        data, found, which = self.data, {}, []
        for s, n in zip(start.tolist(), (count + WIDTH - 1).tolist()):
            which.append(found.setdefault(data[s:s + n], len(found)))
        which = np.array(which, np.int64)
        least = np.full(len(found), NULL_ID)
        np.minimum.at(least, which, ids)
        routes = np.zeros(len(found), np.uint64)
        routes[which] = route
        return routes, least, list(found), (which, start, count, ids)


def suffix_order(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at offsets 0 to len(text), at least ``WIDTH``
    bytes deep (bytes behind the text read as 0), and the common prefix of
    each row and the one before where it is under eight bytes (else 255)."""
    n = len(text)
    word = words_at(text + b"\0" * 9, ">")
    order = np.argsort(word, kind="stable").astype(np.int32)
    word = word[order]
    differ = word[1:] ^ word[:-1]
    del word
    lcp = np.full(n + 2, 255, np.uint8)
    lcp[0] = lcp[n + 1] = 0
    inner = lcp[1:n + 1]
    inner[differ != 0] = 0
    for k in range(1, 8):
        inner[(differ >> np.uint64(8 * (8 - k)) == 0) & (inner != 255)] = k
    del differ
    # the rank of a group of equal suffixes is the row of its first one, so ranks keep the order of all rows
    head = np.concatenate([[True], inner != 255])
    rows = np.arange(n + 1, dtype=np.int32)
    base = np.maximum.accumulate(np.where(head, rows, np.int32(0)))
    rank = np.empty(n + 1, np.int32)
    rank[order] = base
    depth = 8
    while depth < WIDTH:  # prefix doubling, of tied rows only
        tie = ~head
        tie[:-1] |= ~head[1:]
        rows = np.flatnonzero(tie)
        if not len(rows):
            break
        own = order[rows]
        after = np.where(own + depth <= n, rank[np.minimum(own + depth, n)] + 1, 0)
        key = (base[rows].astype(np.int64) << 32) | after
        by = np.argsort(key, kind="stable")
        order[rows] = own[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[rows] = fresh
        base[rows] = np.maximum.accumulate(np.where(fresh, rows, 0))
        rank[order[rows]] = base[rows]
        depth *= 2
    return order, lcp


def lcp_groups(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of all offsets and the ends of the groups of rows that
    agree on ``WIDTH`` bytes."""
    n = len(text)
    order, lcp = suffix_order(text)
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n + 1, dtype=np.int32)
    before = np.frombuffer(b"\0" + text, np.uint8)[order]  # the transform
    back = place[np.maximum(order - 1, 0)]
    start = int(place[0])  # the whole text has no byte before it
    del place
    ends = np.flatnonzero(lcp != 255)  # the intervals of all 8-byte strings lie between these
    begin, end = ends[:-1], ends[1:]
    take = lcp[end] == 7
    take[-1] = False
    begin, end = begin[take], end[take]
    for level in range(8, WIDTH):
        if not len(begin):
            break
        size = end - begin
        total = np.cumsum(size)
        found = []
        # pieces of the frontier, so that the expanded rows stay few
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(PIECE, int(total[-1]) + PIECE, PIECE), "left") + 1]))
        cuts = np.minimum(cuts, len(begin))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            s = size[lo:hi]
            rows = np.repeat(begin[lo:hi] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            key = (np.repeat(np.arange(hi - lo), s) << 8) | before[rows]
            if begin[lo:hi].min() <= start < end[lo:hi].max():
                keep = rows != start
                rows, key = rows[keep], key[keep]
            if not len(rows):
                continue
            by = np.argsort(key, kind="stable")
            key, image = key[by], back[rows[by]]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = np.minimum.reduceat(image, heads), np.maximum.reduceat(image, heads) + 1
            unset = lcp[high] == 255
            low, high = low[unset], high[unset]
            lcp[high] = level
            found.append((low, high))
        begin = np.concatenate([f[0] for f in found]) if found else begin[:0]
        end = np.concatenate([f[1] for f in found]) if found else end[:0]
    return order, np.flatnonzero(lcp != 255)


def solve(contents: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """Per run, for each of its windows: is it in a run with a smaller id?"""
    sizes = np.array([len(c) for c in contents], np.int64)
    text = b"".join(contents)
    order, ends = lcp_groups(text)
    run = np.repeat(np.arange(len(contents), dtype=np.int32), sizes)
    whole = np.arange(len(text), dtype=np.int32) + WIDTH <= np.cumsum(sizes)[run]
    owner = np.full(len(text) + 1, NULL_ID)
    owner[:-1][whole] = least[run[whole]]
    del run
    owner = owner[order]
    group_least = np.minimum.reduceat(owner, ends[:-1])
    lower = np.empty(len(text) + 1, bool)
    lower[order] = np.repeat(group_least, np.diff(ends)) < owner
    lower = lower[:-1] & whole
    edges = np.cumsum(sizes)
    return [lower[e - s:e - WIDTH + 1] for e, s in zip(edges.tolist(), sizes.tolist())]


def _pack(batches):
    from pyspark import TaskContext

    base, k = TaskContext.get().partitionId() << 32, 0
    ids, parts, size = [], [], 0

    def chunk():
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([base + k]), pa.array([size]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([offsets.tobytes()]),
            pa.array([zstandard.ZstdCompressor(6).compress(b"".join(parts)) if size else b""])],
            names=["chunk", "size", "ids", "offsets", "data"])

    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            raw = raw or b""
            if parts and size + len(raw) > CHUNK_BYTES:
                yield chunk()
                ids, parts, size, k = [], [], 0, k + 1
            ids.append(NULL_ID if i is None else i)
            parts.append(raw)
            size += len(raw)
    if parts:
        yield chunk()


def _rows(batches, kind=Chunk):
    for batch in batches:
        for k in range(batch.num_rows):  # one chunk in memory at a time
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, kind(row["ids"], row["offsets"], row["data"])
        pa.default_memory_pool().release_unused()


def _emit_anchors(buckets: int, kind=Chunk):
    def run(batches):
        for row, chunk in _rows(batches, kind):
            uniq, multi, _ = chunk.anchors()
            edges = np.searchsorted(bucket_of(uniq, buckets), np.arange(buckets + 1))
            used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            low = uniq.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array(used, pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()),
                pa.array([low[edges[b]:edges[b + 1]].tobytes() for b in used], pa.binary()),
                pa.array([np.packbits(multi[edges[b]:edges[b + 1]]).tobytes() for b in used], pa.binary())],
                names=["bucket", "chunk", "hashes", "multi"])
    return run


def _find_shared(t: pa.Table) -> pa.Table:
    """Which minimizers of each chunk are in two or more documents, and which are hot."""
    parts = [np.frombuffer(x, np.uint32) for x in t["hashes"].to_pylist()]
    sizes = np.array([len(p) for p in parts])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    count = np.diff(np.append(heads, len(every)))
    seen = np.empty(len(every), np.int64)
    seen[order] = np.repeat(count, count)
    multi = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["multi"].to_pylist(), sizes)])
    shared, hot = (seen > 1) | multi.astype(bool), seen > HOT_CHUNKS
    cuts = np.cumsum(sizes)[:-1]
    pack = lambda bits: pa.array([np.packbits(b).tobytes() for b in np.split(bits, cuts)], pa.binary())
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "shared": pack(shared), "hot": pack(hot)})


def _emit_runs(buckets: int):
    def run(batches):
        for row, chunk in _rows(batches):
            routes, least, contents, _ = chunk.runs(row["flags"] or [], buckets)
            edges = np.searchsorted(bucket_of(routes, buckets), np.arange(buckets + 1))
            used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            packer, data = zstandard.ZstdCompressor(6), []
            for b in used:
                own = contents[edges[b]:edges[b + 1]]
                sizes = np.array([len(c) for c in own], np.uint32)
                data.append(packer.compress(sizes.tobytes() + least[edges[b]:edges[b + 1]].tobytes()
                                            + routes[edges[b]:edges[b + 1]].astype(np.uint32).tobytes() + b"".join(own)))
            yield pa.RecordBatch.from_arrays([
                pa.array(used, pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()),
                pa.array([int(edges[b + 1] - edges[b]) for b in used], pa.int32()), pa.array(data, pa.binary())],
                names=["bucket", "chunk", "n", "data"])
    return run


def _judge_bucket(t: pa.Table) -> pa.Table:
    """Per chunk and run: 0 kept, 1 removed, 2 window by window (bits follow)."""
    sizes, least, routes, blobs, at = [], [], [], [], []
    unpack = zstandard.ZstdDecompressor()
    counts = t["n"].to_pylist()
    for n, blob in zip(counts, t["data"].to_pylist()):
        raw = unpack.decompress(blob)
        s = np.frombuffer(raw, np.uint32, n).astype(np.int64)
        sizes.append(s)
        least.append(np.frombuffer(raw, np.int64, n, 4 * n))
        routes.append(np.frombuffer(raw, np.uint32, n, 12 * n))
        blobs.append(raw)
        at.append(16 * n + np.cumsum(s) - s)
    which = np.repeat(np.arange(len(counts)), counts)
    sizes, least, routes, at = (np.concatenate(x) for x in (sizes, least, routes, at))
    order = np.argsort(routes, kind="stable")
    run_of = np.empty(len(order), np.int64)  # row -> distinct run
    run_least = array("q")
    verdict: dict[int, np.ndarray] = {}
    found: dict[bytes, int] = {}
    todo: list[tuple[int, bytes]] = []
    weight = 0

    def index():
        nonlocal todo, weight
        if todo:
            bits = solve([c for _, c in todo], np.array([run_least[k] for k, _ in todo], np.int64))
            verdict.update({k: b for (k, _), b in zip(todo, bits) if b.any()})
        todo, weight = [], 0

    def close():
        nonlocal found, weight
        if len(found) > 1:  # runs that differ but may share windows
            todo.extend((k, c) for c, k in found.items())
            weight += sum(map(len, found))
            if weight > SLICE_BYTES:
                index()
        found = {}

    last = None
    for lo in range(0, len(order), ROWS):
        own = order[lo:lo + ROWS]
        for row, route, w, a, s, d in zip(own.tolist(), routes[own].tolist(), which[own].tolist(), at[own].tolist(),
                                          sizes[own].tolist(), least[own].tolist()):
            if route != last:
                close()
                last = route
            content = blobs[w][a:a + s]
            k = found.get(content)
            if k is None:
                k = found[content] = len(run_least)
                run_least.append(d)
            elif d < run_least[k]:
                run_least[k] = d
            run_of[row] = k
    close()
    index()
    codes = (least > np.array(run_least)[run_of]).astype(np.uint8)
    codes[(codes == 0) & np.isin(run_of, np.array(list(verdict), np.int64))] = 2
    edges = np.concatenate([[0], np.cumsum(counts)])
    bits = []
    for a, b in zip(edges, edges[1:]):
        own = [verdict[k] for k in run_of[a:b][codes[a:b] == 2].tolist()]
        bits.append(np.packbits(np.concatenate(own)).tobytes() if own else b"")
    pa.default_memory_pool().release_unused()
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"],
                     "codes": pa.array([codes[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                     "bits": pa.array(bits, pa.binary())})


def _cut(buckets: int):
    def run(batches):
        for row, chunk in _rows(batches):
            routes, least, contents, (which, start, count, ids) = chunk.runs(row["flags"] or [], buckets)
            windows = np.array([len(c) - WIDTH + 1 for c in contents], np.int64)
            code = np.zeros(len(contents), np.uint8)
            edges = np.searchsorted(bucket_of(routes, buckets), np.arange(buckets + 1))
            bits: dict[int, np.ndarray] = {}
            for v in row["verdicts"] or []:
                lo, hi = edges[v["bucket"]], edges[v["bucket"] + 1]
                code[lo:hi] = np.frombuffer(v["codes"], np.uint8)
                mixed = lo + np.flatnonzero(code[lo:hi] == 2)
                flat = np.unpackbits(np.frombuffer(v["bits"], np.uint8), count=int(windows[mixed].sum())).astype(bool)
                for k, b in zip(mixed.tolist(), np.split(flat, np.cumsum(windows[mixed])[:-1])):
                    bits[k] = b
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            # an id above the chunk's smallest for the same run: that one has it
            full = (code[which] == 1) | (ids > least[which])
            np.add.at(edge, start[full], 1)
            np.add.at(edge, start[full] + count[full] + WIDTH - 1, -1)
            for o in np.flatnonzero(~full & (code[which] == 2)).tolist():
                w = start[o] + np.flatnonzero(bits[int(which[o])])
                np.add.at(edge, w, 1)
                np.add.at(edge, w + WIDTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            data = np.frombuffer(chunk.data, np.uint8)
            out_spans, kept = [], []
            for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
                g = gone[a:b]
                if not g.any():
                    out_spans.append([])
                    kept.append(chunk.data[a:b])
                    continue
                turn = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                out_spans.append([{"begin": x, "end": y} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist())])
                kept.append(data[a:b][~g].tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i == NULL_ID else i for i in chunk.ids.tolist()], pa.int64()),
                pa.array(np.diff(chunk.offsets)),
                pa.array(out_spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])
    return run


def pack(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The chunk table of ``docs`` and the number of hash buckets for its bytes."""
    packed = reliable_checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                                     .mapInArrow(_pack, "chunk long, size long, ids binary, offsets binary, data binary"))
    total = packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return packed, max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))


def shared_routes(packed: DataFrame, buckets: int, kind=Chunk) -> DataFrame:
    """``chunk``, ``flags``: which of a chunk's routes occur in two or more documents.
    A chunk has a bounded number of routes, so its flags are a bounded row."""
    anchors = packed.mapInArrow(_emit_anchors(buckets, kind), "bucket int, chunk long, hashes binary, multi binary")
    shared = anchors.groupBy("bucket").applyInArrow(_find_shared, "chunk long, bucket int, shared binary, hot binary")
    return reliable_checkpoint(shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("flags")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``id``, ``n_bytes``, ``spans`` (maximal
    removed runs as byte offsets) and ``kept`` (the remaining bytes)."""
    packed, buckets = pack(docs, id_col, text_col)
    lists = ["ids", "offsets", "data"]
    flags = shared_routes(packed, buckets)
    runs = (packed.join(flags, "chunk").select("chunk", *lists, "flags")
                  .mapInArrow(_emit_runs(buckets), "bucket int, chunk long, n int, data binary"))
    verdicts = (runs.groupBy("bucket").applyInArrow(_judge_bucket, "chunk long, bucket int, codes binary, bits binary")
                    .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes", "bits")).alias("verdicts")))
    return (packed.join(flags, "chunk", "left").join(verdicts, "chunk", "left").select("chunk", *lists, "flags", "verdicts")
                  .mapInArrow(_cut(buckets), "id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary"))
