"""Near-duplicate passages by compact windows.

Tokens are the 5-word shingles of the lower-cased words; a passage has 50
words or more, that is ``SPAN`` tokens.  For each of ``BANDS * HASHES`` hash
functions the Cartesian tree of a document's token hashes (least at the root)
groups its subsequences: all subsequences that share their min-hash token at
``c`` form one compact window (l, c, r), and only windows of ``SPAN`` tokens
or more are made, about two in ``SPAN`` tokens.  Each function's windows cut
the axis of subsequence starts into intervals; an interval join of the
functions of a band gives cells of subsequences that share all its min-hashes.
Documents meet by the cell's min-hashes:

* cells with the same tokens are repeated passages at once;
* other cells of one key are verified: some stretch of 50 words or more in
  each, with Jaccard similarity of 0.8 or more - needed only where their
  documents are not in one class yet.

A repeated passage always meets (its own subsequence has the same min-hashes
everywhere); one of similarity 0.8 meets with probability
``1 - (1 - 0.8 ** HASHES) ** BANDS`` for each independent stretch.  Classes are the
connected components of documents; equal cells are chained to the smallest id
and hot keys are compared in blocks, so no group is expanded into pairs.

Defined cases: null, empty and short texts have no passages; a null id is in
no class; rows with one id are one document; an empty table gives an empty
result; other columns are not kept.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.substring import NULL_ID, Chunk, _mix, _rows, bucket_of, flag_bits, pack, shared_routes
from ledgerline.session import reliable_checkpoint, shuffle_partitions

WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
SPAN = WORDS - SHINGLE + 1
BANDS, HASHES = 5, 3
BLOCK = 128
LEAST = int(np.ceil(SPAN * 2 * SIMILARITY / (1 + SIMILARITY) - 1e-9))  # common tokens of similar stretches
_P = 0x9E3779B97F4A7C15 | 1
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def range_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end] for every range, independent of its place."""
    size = 1 << max(10, int(len(values)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * power[:len(values)], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * inverse[begin])


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word."""
    raw = np.frombuffer(data.lower(), np.uint8)
    gap = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(raw), bool)
    before[1:] = gap[:-1]
    after = np.ones(len(raw), bool)
    after[:-1] = gap[1:]
    begin = np.flatnonzero(~gap & (before | edge[:-1]))
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return range_hash(raw.astype(np.uint64), begin, end), np.searchsorted(offsets, begin, "right") - 1


def window_starts(values: np.ndarray, doc: np.ndarray, last_doc: np.ndarray):
    """First and last start and least value of every compact window of ``SPAN``
    tokens or more; arguments as in :func:`compact_windows`."""
    n = len(values) - SPAN + 1
    least = values
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:width - SPAN], least[SPAN - width:])
    good = doc[:n] == last_doc[:n]
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (doc[1:n] != doc[:n - 1]) | ~good[:-1]
    first = np.flatnonzero(change & good)
    marks = np.append(np.flatnonzero(change | ~good), n)
    last = marks[np.searchsorted(marks, first, "right")] - 1 if len(first) else first
    return first, last, least[first]


def compact_windows(values: np.ndarray, doc: np.ndarray, last_doc: np.ndarray):
    """Compact windows of ``SPAN`` tokens or more of all documents laid end to end.

    ``values``: token hashes; ``doc``: document of each token; ``last_doc``:
    document of the token ``SPAN - 1`` further on.  Returns (first start, last
    start, l, c, r, least value): starts are those of the ``SPAN``-token
    subsequences whose least token is c.  The Cartesian tree's spans l and r
    follow from the nearest smaller window value on each side.
    """
    first, last, value = window_starts(values, doc, last_doc)
    if not len(first):
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    own = doc[first]
    center = first + np.argmax(values[first[:, None] + np.arange(SPAN)] == value[:, None], axis=1)
    doc_first, doc_last = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right") - 1

    def nearest(step):
        """Nearest window on one side with a smaller value, by climbing pointers."""
        at = np.arange(len(first)) + step
        while True:
            inside = (at >= 0) & (at < len(first))
            spot = np.clip(at, 0, len(first) - 1)
            climb = inside & (own[spot] == own) & (value[spot] >= value)
            if not climb.any():
                return np.where(inside & (own[spot] == own), at, -1)
            at = np.where(climb, at[spot], at)

    left, right = nearest(-1), nearest(1)
    # a subsequence set cut short on a side ends at a smaller token right there; else it reaches the nearest smaller one
    l = np.where(first > np.maximum(center - SPAN + 1, doc_first), first, np.where(left >= 0, center[left] + 1, doc_first))
    r = np.where(last < np.minimum(center, doc_last - SPAN + 1), last + SPAN - 1, np.where(right >= 0, center[right] - 1, doc_last))
    return first, last, np.minimum(l, first), center, np.maximum(r, last + SPAN - 1), value


class PassageChunk(Chunk):
    """Cells of all bands of a packed chunk; ``route`` is the cell's key.  The
    spans ``l`` and ``r`` are worked out where they are asked for."""

    def __init__(self, ids: bytes, offsets: bytes, data: bytes, spans: bool = False):
        import zstandard

        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
        words, word_doc = word_hashes(raw, self.offsets) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        n = len(words) - SHINGLE + 1
        cells = [[] for _ in range(6)]  # route, doc, first start, last start, l, r
        self.tokens = np.zeros(0, np.uint64)
        if n >= SPAN:
            tokens = words[:n].copy()
            for j in range(1, SHINGLE):
                tokens = tokens * np.uint64(_P) + words[j:j + n]
            self.tokens = tokens = _mix(tokens)
            doc = word_doc[:n]
            # a subsequence of SPAN tokens ends with the word WORDS - 1 behind its start
            last_doc = word_doc[WORDS - 1:]
            # tokens that cross into the next document are in no valid subsequence
            for band in range(BANDS):
                parts = []
                for k in range(HASHES):
                    salt = np.uint64((HASHES * band + k + 1) * 0x5851F42D4C957F2D % (1 << 64))
                    values = _mix((tokens ^ salt) * np.uint64(0xD6E8FEB86659FD93))
                    parts.append(compact_windows(values, doc, last_doc) if spans else window_starts(values, doc, last_doc))
                if not len(parts[0][0]):
                    continue
                # interval join of the functions' partitions of the same starts
                first = np.unique(np.concatenate([p[0] for p in parts]))
                at = [np.searchsorted(p[0], first, "right") - 1 for p in parts]
                picked = [[x[a] for x in p] for p, a in zip(parts, at)]
                key = np.full(len(first), band + 1, np.uint64)
                for p in picked:
                    key = _mix((key ^ p[-1]) * np.uint64(_P))
                rows = [key, doc[first], first, np.minimum.reduce([p[1] for p in picked])]
                if spans:
                    rows += [np.maximum.reduce([p[2] for p in picked]), np.minimum.reduce([p[4] for p in picked])]
                for out, x in zip(cells, rows):
                    out.append(x)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.route = join(cells[0], np.uint64)
        self.doc, self.first, self.last, self.l, self.r = (join(x, np.int64) for x in cells[1:])

    def content(self) -> np.ndarray:
        """Hash of the tokens under each cell's subsequences."""
        return range_hash(self.tokens, self.first, self.last + SPAN) if len(self.route) else np.zeros(0, np.uint64)

    def region(self, k: int) -> np.ndarray:
        """Tokens (32 bits of them) of the widest subsequence of a cell, at most ``SPAN`` beyond either side."""
        return self.tokens[max(self.l[k], self.first[k] - SPAN):min(self.r[k], self.last[k] + 2 * SPAN) + 1].astype(np.uint32)


def _emit_cells(buckets: int):
    """Distinct shared cells per bucket; links inside the chunk under bucket -1."""
    def run(batches):
        for row, chunk in _rows(batches, PassageChunk):
            uniq, _, inv = chunk.anchors() if len(chunk.route) else (chunk.route, None, chunk.doc)
            shared = flag_bits(uniq, row["flags"] or [], buckets, "shared")[inv] if len(uniq) else np.zeros(0, bool)
            ids = chunk.ids[chunk.doc]
            shared &= ids != NULL_ID
            route, content, ids = chunk.route[shared], chunk.content()[shared], ids[shared]
            order = np.lexsort((ids, content, route))
            route, content, ids = route[order], content[order], ids[order]
            head = np.ones(len(route), bool)
            head[1:] = (route[1:] != route[:-1]) | (content[1:] != content[:-1])
            group = np.cumsum(head) - 1
            least = ids[head]
            links = np.unique(np.stack([ids, least[group]], axis=1)[ids != least[group]], axis=0)
            route, content = route[head], content[head]
            edges = np.searchsorted(bucket_of(route, buckets), np.arange(buckets + 1))
            used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            data = [route[edges[b]:edges[b + 1]].astype(np.uint32).tobytes() + content[edges[b]:edges[b + 1]].tobytes()
                    + least[edges[b]:edges[b + 1]].tobytes() for b in used]
            sizes = [int(edges[b + 1] - edges[b]) for b in used]
            yield pa.RecordBatch.from_arrays([
                pa.array([*used, -1], pa.int32()), pa.array([row["chunk"]] * (len(used) + 1), pa.int64()),
                pa.array([*sizes, len(links)], pa.int32()), pa.array([*data, links.tobytes()], pa.binary())],
                names=["bucket", "chunk", "n", "data"])
    return run


_LINKS = "a long, b long, key long, chunk long"


def _unpack_links(batches):
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pairs = np.frombuffer(data, np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _link_bucket(t: pa.Table) -> pa.Table:
    """Links (a, b) between equal cells and, with a key, the cells (document a,
    content b) of keys that have several contents."""
    keys, contents, ids, chunks = [], [], [], []
    for n, chunk, data in zip(t["n"].to_pylist(), t["chunk"].to_pylist(), t["data"].to_pylist()):
        keys.append(np.frombuffer(data, np.uint32, n))
        contents.append(np.frombuffer(data, np.uint64, n, 4 * n))
        ids.append(np.frombuffer(data, np.int64, n, 12 * n))
        chunks.append(np.full(n, chunk))
    key, content, own, chunk = (np.concatenate(x) for x in (keys, contents, ids, chunks))
    order = np.lexsort((own, content, key))
    key, content, own, chunk = key[order], content[order], own[order], chunk[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    group = np.cumsum(head) - 1
    least = own[head]
    links = np.unique(np.stack([own, least[group]], axis=1)[own != least[group]], axis=0)
    key, content, chunk = key[head], content[head], chunk[head]
    several = np.zeros(len(key), bool)
    several[1:] |= key[1:] == key[:-1]
    several[:-1] |= key[1:] == key[:-1]
    bucket = t["bucket"][0].as_py()
    full = (np.int64(bucket) << 32) | key[several].astype(np.int64)
    none = pa.nulls(len(links), pa.int64())
    return pa.table({"a": pa.concat_arrays([pa.array(links[:, 0]), pa.array(least[several])]),
                     "b": pa.concat_arrays([pa.array(links[:, 1]), pa.array(content[several].view(np.int64))]),
                     "key": pa.concat_arrays([none, pa.array(full)]),
                     "chunk": pa.concat_arrays([none, pa.array(chunk[several])])})


def _emit_regions(buckets: int):
    """Tokens of the asked-for cells of each chunk."""
    def run(batches):
        for row, chunk in _rows(batches, partial(PassageChunk, spans=True)):
            key = (bucket_of(chunk.route, buckets) << 32) | chunk.route.astype(np.uint32).astype(np.int64)
            content = chunk.content().view(np.int64)
            spot: dict = {}
            wanted = {w["key"] for w in row["wanted"]}
            for k in np.flatnonzero(np.isin(key, np.fromiter(wanted, np.int64, len(wanted)))).tolist():
                spot.setdefault((int(key[k]), int(content[k])), k)
            asked = [w for w in row["wanted"] if (w["key"], w["content"]) in spot]
            yield pa.RecordBatch.from_arrays([
                pa.array([w["key"] for w in asked], pa.int64()), pa.array([w["root"] for w in asked], pa.int64()),
                pa.array([w["id"] for w in asked], pa.int64()),
                pa.array([chunk.region(spot[w["key"], w["content"]]).tobytes() for w in asked], pa.binary())],
                names=["key", "root", "id", "tokens"])
    return run


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Is there a stretch of ``SPAN`` tokens or more in each, with Jaccard
    similarity of ``SIMILARITY`` or more?  Tries the longest stretch whose
    share of common tokens allows it, then the one richest in them."""
    share = 2 * SIMILARITY / (1 + SIMILARITY)

    def stretches(tokens, common):
        """The longest and the richest stretch, in linear memory: runs of cells over repetitive text are long."""
        level = np.concatenate([[0.0], np.cumsum(np.isin(tokens, common) - share)])
        least = np.minimum.accumulate(level)
        begin = np.searchsorted(-least, -(level + 1e-9), "left")  # first place no higher than each end
        end = int(np.argmax(np.arange(len(level)) - begin))
        if end - begin[end] < SPAN:
            return []
        gain = level[SPAN:] - least[:len(level) - SPAN]
        rich = int(np.argmax(gain)) + SPAN
        best = {(int(begin[end]), end)}
        if gain[rich - SPAN] >= -1e-9:
            best.add((int(np.searchsorted(-least, -(least[rich - SPAN] + 1e-12), "left")), rich))
        return [tokens[i:j] for i, j in sorted(best)]

    for a in stretches(x, y):
        for b in stretches(y, a):
            both = len(np.intersect1d(a, b))
            if both >= SIMILARITY * (len(np.unique(a)) + len(np.unique(b)) - both):
                return True
    return False


def _verify_blocks(batches):
    """Links between classes inside pairs of blocks (a block with itself: no
    second one); classes joined here are not compared again."""
    for batch in batches:
        for k in range(batch.num_rows):  # one pair of blocks in memory at a time
            left, right = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            root: dict = {}

            def find(i):
                while root.setdefault(i, i) != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            found = []
            rows = []
            for side in (left, right) if right is not None else (left,):
                tokens = [np.frombuffer(r["tokens"], np.uint32) for r in side]
                rows.append([(r["root"], t, set(t.tolist())) for r, t in zip(side, tokens)])
            for (x, tx, sx), (y, ty, sy) in product(*rows) if right is not None else combinations(rows[0], 2):
                if x != y and find(x) != find(y) and (len(sx & sy) >= LEAST or len(sx) < len(tx)) and similar(tx, ty):
                    root[find(x)] = find(y)
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``class_id`` (smallest id linked by passages, its own if none),
    ``class_size``, a row per row of ``docs``."""
    packed, buckets = pack(docs, id_col, text_col)
    lists = ["ids", "offsets", "data"]
    flags = shared_routes(packed, buckets, PassageChunk)
    cells = reliable_checkpoint(packed.join(flags, "chunk").select("chunk", *lists, "flags")
                                      .mapInArrow(_emit_cells(buckets), "bucket int, chunk long, n int, data binary"))
    near = cells.where("bucket < 0").select("n", "data").mapInArrow(_unpack_links, "a long, b long")
    found = reliable_checkpoint(cells.where("bucket >= 0").groupBy("bucket").applyInArrow(_link_bucket, _LINKS))
    first = reliable_checkpoint(components(near.unionByName(found.where(F.col("key").isNull()).select("a", "b"))))
    # cells of one key in several classes
    open_cells = (found.where(F.col("key").isNotNull())
                       .join(first.withColumnRenamed("node", "a"), "a", "left")
                       .select("key", "chunk", F.col("a").alias("id"), F.col("b").alias("content"), F.coalesce("root", "a").alias("root")))
    open_cells = reliable_checkpoint(open_cells)
    torn = open_cells.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    torn = torn.where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    wanted = (open_cells.join(torn.select("key"), "key").groupBy("chunk")
                        .agg(F.collect_list(F.struct("key", "content", "id", "root")).alias("wanted")))
    regions = (packed.join(wanted, "chunk").select("chunk", *lists, "wanted")
                     .mapInArrow(_emit_regions(buckets), "key long, root long, id long, tokens binary"))
    blocks = reliable_checkpoint(
        regions.join(torn, "key").withColumn("block", F.pmod(F.xxhash64("root", "id", "tokens"), F.col("blocks")).cast("int"))
               .groupBy("key", "block").agg(F.collect_list(F.struct("root", "tokens")).alias("rows")))
    pairs = (blocks.select("key", F.col("block").alias("i"), F.col("rows").alias("x"))
                   .join(blocks.select("key", F.col("block").alias("j"), F.col("rows").alias("y")), "key").where("i <= j"))
    n = shuffle_partitions(docs.sparkSession)
    pairs = pairs.withColumn("y", F.when(F.col("i") < F.col("j"), F.col("y")))
    late = pairs.repartition(n, "key", "i", "j").select("x", "y").mapInArrow(_verify_blocks, "a long, b long")
    rows = docs.sparkSession.conf.get(ARROW_ROWS)
    docs.sparkSession.conf.set(ARROW_ROWS, "16")  # pairs of blocks are wide rows
    late = reliable_checkpoint(late)
    docs.sparkSession.conf.set(ARROW_ROWS, rows)
    classes = reliable_checkpoint(components(
        first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late)))
    sizes = classes.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"))
    named = classes.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("class_id"), "class_size")
    out = docs.select(F.col(id_col).cast("long").alias("id")).join(named, "id", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
