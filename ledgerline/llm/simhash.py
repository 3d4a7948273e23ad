"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
binary Golay code decodes a 23-bit word to one of 4096 codewords; words at
distance two or less share a codeword of their one-bit neighbourhoods (one or
six codewords each).  With four differing bits over three segments either

* a segment agrees exactly and another one differs in two bits or less:
  key = (exact segment, shared codeword of the other), or
* two segments differ in exactly one bit: key = (both codewords, parities),
  where one side decodes its own word in the first segment and the
  neighbourhood in the second, and the other side the reverse.

So every pair within four bits shares a key.  Fingerprints (distinct ones)
meet by key, are verified by exact distance in numpy blocks, and each batch
passes on a spanning star of the links it found, never all pairs.  Key groups
beyond ``HOT`` are cut into blocks whose pairs are spread over tasks.

Defined cases: null, empty and wordless texts have fingerprint zero and are
linked like any other; equal fingerprints are one component; a null id never
becomes a component id unless all ids of a component are null (then the
component id is null); repeated rows are kept as rows.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import as_bytes
from ledgerline.llm.components import components
from ledgerline.session import reliable_checkpoint, shuffle_partitions

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
MAX_BITS = 4
HOT = 8192
SMALL = 48
BLOCK = 2048


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles (repeats included)."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), seed) for i in range(n)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    def run(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint(raw or b"", shingle) for raw in as_bytes(texts)], np.uint64)
        return pa.array(out.view(np.int64))

    return docs.withColumn(name, F.arrow_udf(run, T.LongType())(F.col(text_col).cast("string")))


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, error pattern of each syndrome."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for n in range(1, 4):
        for places in combinations(range(23), n):
            e = sum(1 << p for p in places)
            errors[_remainder(e)] = e
    return low, high, errors


_TABLES: list = []


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits of each 23-bit word."""
    if not _TABLES:
        _TABLES.extend(_golay())
    low, high, errors = _TABLES
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def _near(words: np.ndarray, bits: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) of the distinct codewords of the words one bit away (``own``: and of the words themselves)."""
    flips = np.array([1 << b for b in range(bits)] + [0] * own, np.int64)
    codes = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    keep = np.ones(codes.shape, bool)
    keep[:, 1:] = codes[:, 1:] != codes[:, :-1]
    rows, cols = np.nonzero(keep)
    return rows, codes[rows, cols]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints.  The lowest key bit is
    the role: pairs meet within role 0 of exact keys and across roles else."""
    segs = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    bits = [n for _, n in SEGMENTS]
    own = [decode(s) for s in segs]
    parity = [np.bitwise_count(s).astype(np.int64) & 1 for s in segs]
    ball = [_near(s, n, True) for s, n in zip(segs, bits)]
    sphere = [_near(s, n, False) for s, n in zip(segs, bits)]
    rows, keys = [], []

    def put(tag, r, value, role):
        rows.append(r)
        keys.append((((np.int64(tag) << 36) | value) << 1) | role)

    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        r, code = ball[j]
        put(tag, r, (segs[i][r] << 12) | code, 0)
    for tag, (i, j) in enumerate(combinations(range(3), 2), 6):
        r, code = sphere[j]
        put(tag, r, (((own[i][r] << 12) | code) << 2) | (parity[i][r] << 1) | (parity[j][r] ^ 1), 0)
        r, code = sphere[i]
        put(tag, r, (((code << 12) | own[j][r]) << 2) | ((parity[i][r] ^ 1) << 1) | parity[j][r], 1)
    return np.concatenate(rows), np.concatenate(keys)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the links a-b, nodes other than the least."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links_small(group: np.ndarray, role: np.ndarray, fps: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside adjacent equal groups, by comparing at every offset."""
    a, b, s = [], [], 1
    alive = np.arange(len(group))
    while len(alive := alive[alive + s < len(group)]):
        alive = alive[group[alive] == group[alive + s]]
        if not len(alive):
            break
        x, y = alive, alive + s
        ok = (exact[x] | (role[x] != role[y])) & (fps[x] != fps[y])
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(fps[x] ^ fps[y]) <= MAX_BITS
        a.append(fps[x[ok]])
        b.append(fps[y[ok]])
        s += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links_large(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the verified links between two blocks, in tiles."""
    a, b = [], []
    for i in range(0, len(left), BLOCK):
        for j in range(0, len(right), BLOCK):
            x, y = left[i:i + BLOCK], right[j:j + BLOCK]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= MAX_BITS)
            p, q = x[p], y[q]
            differ = p != q
            s = stars(p[differ], q[differ])
            a.append(s[0])
            b.append(s[1])
    return stars(np.concatenate(a), np.concatenate(b))


_PAIRS = "a long, b long, grp long, block int, data binary"


def _batch(a, b, blocks=()) -> pa.RecordBatch:
    n, m = len(a), len(blocks)
    none = [None]
    return pa.RecordBatch.from_arrays([
        pa.array(a.astype(np.uint64).view(np.int64).tolist() + none * m, pa.int64()),
        pa.array(b.astype(np.uint64).view(np.int64).tolist() + none * m, pa.int64()),
        pa.array(none * n + [x[0] for x in blocks], pa.int64()),
        pa.array(none * n + [x[1] for x in blocks], pa.int32()),
        pa.array(none * n + [x[2] for x in blocks], pa.binary())], names=["a", "b", "grp", "block", "data"])


def _verify(batches):
    """Rows sorted by key: links as stars, hot groups as blocks of fingerprints."""
    def finish(keys, fps):
        group, role = keys >> 1, keys & 1
        exact = (group >> 36) < 6
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        a, b = _links_small(group[small], role[small], fps[small], exact[small])
        a, b, blocks = [a], [b], []
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            own = np.unique(fps[at:at + n])
            if len(own) > HOT:
                blocks += [(int(group[at]), k, own[i:i + HOT].tobytes())
                           for k, i in enumerate(range(0, len(own), HOT))]
                continue
            s = _links_large(own, own)
            a.append(s[0])
            b.append(s[1])
        return *stars(np.concatenate(a), np.concatenate(b)), blocks

    held_k, held_f, hot, block, rows = [], [], None, 0, 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        while len(keys):
            if hot is not None:  # the rest of a group beyond HOT goes on as blocks
                n = int(np.searchsorted(keys >> 1, hot, side="right"))
                for at in range(0, n, HOT):
                    yield _batch(fps[:0], fps[:0], [(hot, block, fps[at:min(at + HOT, n)].tobytes())])
                    block += 1
                keys, fps = keys[n:], fps[n:]
                if len(keys):
                    hot = None
                continue
            held_k.append(keys)
            held_f.append(fps)
            rows += len(keys)
            keys = keys[:0]
            if rows < 65536:
                continue
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            cut = int(np.searchsorted(k >> 1, k[-1] >> 1, side="left"))
            if cut:
                yield _batch(*finish(k[:cut], f[:cut]))
            held_k, held_f, rows = [k[cut:]], [f[cut:]], len(k) - cut
            if rows > HOT:
                hot, block = int(k[-1] >> 1), 0
                for at in range(0, rows, HOT):
                    yield _batch(f[:0], f[:0], [(hot, block, f[cut:][at:at + HOT].tobytes())])
                    block += 1
                held_k, held_f, rows = [], [], 0
    if rows:
        yield _batch(*finish(np.concatenate(held_k), np.concatenate(held_f)))


def _verify_blocks(batches):
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield _batch(*_links_large(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that span the graph of distinct fingerprints (one
    signed long column ``fp``) within ``MAX_BITS`` bits of each other."""
    def keyed(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 4096):
                part = f[at:at + 4096]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["k", "fp"])

    n = shuffle_partitions(fps.sparkSession)
    rows = (fps.mapInArrow(keyed, "k long, fp long")
               .repartition(n, F.shiftright("k", 1)).sortWithinPartitions("k"))
    found = reliable_checkpoint(rows.mapInArrow(_verify, _PAIRS))
    blocks = found.where(F.col("data").isNotNull())
    pairs = (blocks.select("grp", F.col("block").alias("i"), F.col("data").alias("x"))
                   .join(blocks.select("grp", F.col("block").alias("j"), F.col("data").alias("y")), "grp")
                   .where(F.col("i") <= F.col("j")))
    spread = pairs.repartition(n, "grp", "i", "j").select("x", "y").mapInArrow(_verify_blocks, _PAIRS)
    return found.where(F.col("a").isNotNull()).select("a", "b").unionByName(spread.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    carry: dict | None = None) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``fp``, ``component_id`` (smallest id
    reachable), ``root`` (one fingerprint that names the component) and the
    ``carry`` expressions over ``docs``, if any."""
    carry = carry or {}
    prints = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_ll8_text"), *[c.alias(n) for n, c in carry.items()])
    prints = reliable_checkpoint(with_fingerprint(prints, "_ll8_text", shingle).drop("_ll8_text"))
    return prints.join(fingerprint_components(prints), "fp", "left").select("id", "fp", "component_id", "root", *carry)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` (all columns) that represent their component: the
    row with the smallest id; of rows that share it, one."""
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")), F.xxhash64(F.col(text_col))
    found = near_duplicates(docs, id_col, text_col, shingle, {"_ll8_k": key, "_ll8_t": text})
    best = (found.where(F.col("id").eqNullSafe(F.col("component_id")))
                 .groupBy("root").agg(F.min(F.struct("_ll8_k", "_ll8_t")).alias("m")).select("m.*"))
    return (docs.withColumn("_ll8_k", key).withColumn("_ll8_t", text)
                .join(best, ["_ll8_k", "_ll8_t"], "left_semi").dropDuplicates(["_ll8_k", "_ll8_t"])
                .drop("_ll8_k", "_ll8_t"))


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """``fp``, ``component_id``, ``root`` of every distinct fingerprint of (``id``, ``fp``)."""
    distinct = reliable_checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = reliable_checkpoint(components(links(distinct.select("fp"))))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(best, "root").select(F.col("node").alias("fp"), "component_id", "root")
    return distinct.join(named, "fp", "left").select(
        "fp", F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"))
