"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles.  Two
sets link if their Jaccard similarity is ``percent`` or more.

1. *Bands.*  Sizes are cut into bands [l, floor(l / t)], t = percent / 100, so
   similar sets lie in one band or in two neighbouring ones, and in instance j
   (bands j - 1 and j, sizes up to r) they differ in at most
   k = floor(2 r (1 - t) / (1 + t)) elements.  A set takes part in the instance
   of its own band and in the next one.
2. *Signatures.*  An instance cuts the domain of shingles into
   n1 = ceil((k + 1) / 2) parts: in one of them similar sets differ in at most
   one element.  Every part is cut into n2 subsets, and each choice of n2 - 1
   of them gives a signature (the hash of the set's elements there): one choice
   leaves the odd element out, so similar sets share a signature.  n2 is 4 for
   small k, else 2.  Sets with k = 0 link only with equal ones.
3. *Groups.*  One range partitioning of (signature, id) rows, split inside hot
   signatures too, is walked in order: a group's members are tied to its
   smallest id, runs that cross a border are tied by one row a partition.
   Equal sets are tied by their hash and stand for one member.
4. *Verify.*  The distinct (member, smallest id) pairs are checked on the whole
   sets.  Checked links give first components.  Groups whose other members
   still lie in several components are compared among themselves: one group
   per distinct list of members, in blocks of ``BLOCK`` members, pairs of one
   component skipped.  Members of groups beyond ``CUT`` are first keyed anew by
   the signatures of a second, independent cut, so only sets that agree in
   both meet.  Blocks hold sketches (parities of the set's elements by bits of
   their hash: the distance of two sketches is at most that of the sets and
   little less); pairs near enough by them are checked on the whole sets.

Every link between different sets is thus found or implied by its component.

Defined cases: null, empty and word-less texts have the empty set and link
with nothing; fewer words than a shingle are one shingle; a null id is in no
component (its result is null); rows with one id are one document, linked by
any of its texts; repeated rows repeat the result; an empty table gives an
empty result; other columns are not kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, as_bytes, small_side
from ledgerline.llm.components import components
from ledgerline.llm.passages import word_hashes
from ledgerline.llm.substring import _mix
from ledgerline.session import reliable_checkpoint, shuffle_partitions

PIECE_BYTES = 4 << 20  # of text, hashed at a time
FINE = 7  # up to this k parts are cut into four subsets
BLOCK, CUT = 256, 2048
WALK_ROWS = 1 << 16
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_SPACES = b" \t\n\r\x0b\x0c"


@lru_cache(maxsize=8)
def bands(percent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First size and k of every band up to the one after ``size``'s band."""
    first, differ, low, extra = [], [], 1, 2
    while extra:
        high = low * 100 // percent
        first.append(low)
        differ.append(2 * high * (100 - percent) // (100 + percent))
        extra -= low > size
        low = high + 1
    return np.array(first), np.array(differ)


def _words(raw: bytes) -> np.ndarray:
    """Hashes of the words of one text, piece by piece."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        if end < len(raw):  # a piece ends at white space (or after a word longer than it)
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            else:
                nexts = [p for p in (raw.find(c, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                end = min(nexts, default=len(raw))
        out.append(word_hashes(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, ordered by both."""
    small = [t for t in texts if len(t) <= PIECE_BYTES]
    if len(small) == len(texts) and sum(map(len, texts)) <= 2 * PIECE_BYTES:
        words, doc = word_hashes(b"".join(texts), np.cumsum([0] + [len(t) for t in texts])) if any(texts) else (np.zeros(0, np.uint64),) * 2
        doc = doc.astype(np.int64)
    else:
        parts = [_words(t) for t in texts]
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    tokens, owner = [], []
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.cumsum(n) - n
    for size in range(1, shingle + 1):
        if size < shingle:  # the whole of a short text
            at = first[n == size]
        else:
            at = np.arange(max(len(words) - size + 1, 0))
            at = at[doc[at] == doc[at + size - 1]]
        value = np.full(len(at), size, np.uint64)
        for j in range(size):
            value = value * _M[0] + words[at + j]
        tokens.append(_mix(value))
        owner.append(doc[at])
    token, own = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return own[new], token[new]


def signatures(own: np.ndarray, token: np.ndarray, documents: int, percent: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) rows, ordered by document."""
    size = np.bincount(own, minlength=documents)
    low, differ = bands(percent, int(size.max(initial=1)))
    band = np.searchsorted(low, size, "right") - 1
    spread = _mix((token ^ np.uint64(seed * 0x5851F42D4C957F2D % (1 << 64))) * _M[1])
    value = _mix(spread * _M[2] + np.uint64(1))
    docs, found = [], []
    for step in (0, 1):
        k = np.where(size > 0, differ[np.clip(band + step, 0, len(differ) - 1)], 0)
        for subsets, chosen in ((4, (k > 0) & (k <= FINE)), (2, k > FINE)):
            if not chosen.any():
                continue
            parts = np.where(chosen, (k + 2) // 2, 0)
            base = np.cumsum(parts) - parts
            use = chosen[own]
            cells = (parts * subsets)[own[use]].astype(np.uint64)
            cell = base[own[use]] * subsets + ((spread[use] >> np.uint64(32)) * cells >> np.uint64(32)).astype(np.int64)
            total = np.zeros(int(parts.sum()) * subsets, np.uint64)
            np.add.at(total, cell, value[use])
            total = total.reshape(-1, subsets)
            rest = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total  # each choice leaves one subset out
            owner = np.repeat(np.arange(documents), parts)
            place = np.arange(len(owner)) - base[owner]
            salt = ((band[owner] + step).astype(np.uint64) << np.uint64(40)) + (place.astype(np.uint64) << np.uint64(3))
            salt = salt[:, None] + np.arange(subsets, dtype=np.uint64)
            found.append(_mix(rest * _M[0] + _mix(salt * _M[2] + np.uint64(seed + 1))).ravel())
            docs.append(np.repeat(owner, subsets))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, sig = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    return doc[order], sig[order]


def _lists(own: np.ndarray, values: np.ndarray, documents: int) -> pa.Array:
    offsets = np.searchsorted(own, np.arange(documents + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(shingle: int, percent: int, whole: bool):
    """Per document: size, hash and signatures of the set; ``whole``: also its
    elements, and the signatures are those of the second cut."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            own, token = shingle_sets(texts, shingle)
            doc, sig = signatures(own, token, len(texts), percent, seed=int(whole))
            keys = np.zeros((2, len(texts)), np.uint64)
            np.add.at(keys[0], own, _mix(token * _M[1]))
            np.add.at(keys[1], own, _mix(token * _M[2] + np.uint64(7)))
            columns = [batch.column(0), pa.array(np.bincount(own, minlength=len(texts)))]
            if whole:
                cuts = np.split(token, np.searchsorted(own, np.arange(1, len(texts))))
                columns += [_lists(own, token, len(texts)), pa.array([_sketch(c) for c in cuts], pa.binary())]
            else:
                columns += [pa.array(k.view(np.int64)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, _lists(doc, sig, len(texts))],
                                             names=["id", "n", "shingles", "sketch", "sigs"] if whole else ["id", "n", "k1", "k2", "sigs"])
    return run


def _sketch(token: np.ndarray) -> bytes:
    """Parities of the set's elements by the low bits of their hash, two to four bits an element."""
    size = 1 << max(6, int(2 * len(token) - 1).bit_length())
    return np.packbits(np.bincount((token & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _fold(sketch: bytes, size: int) -> np.ndarray:
    """The sketch at ``size`` bytes: the halves' parities add up."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def _may_link(percent: int):
    """Pairs of members of different components in a pair of blocks (``y`` null:
    inside ``x``) whose sketches are near enough for a link."""
    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                sides = [c[j].as_py() for c in (batch.column(0), batch.column(1))]
                size = min(len(r["sketch"]) for side in sides if side is not None for r in side)
                blocks = [(np.array([r["id"] for r in side]), np.array([r["root"] for r in side]), np.array([r["n"] for r in side]),
                           np.stack([_fold(r["sketch"], size) for r in side])) for side in sides if side is not None]
                own, others = blocks[0], blocks[-1]
                found = []
                for p in range(len(own[0])):
                    end = p if len(blocks) == 1 else len(others[0])
                    ids, roots, n, bits = (x[:end] for x in others)
                    differ = np.bitwise_count(bits ^ own[3][p]).sum(axis=1, dtype=np.int64)
                    near = (roots != own[1][p]) & (100 * np.minimum(n, own[2][p]) >= percent * np.maximum(n, own[2][p]))
                    near &= differ * (100 + percent) <= (n + own[2][p]) * (100 - percent)
                    found += [(int(own[0][p]), int(i)) for i in ids[near]]
                yield pa.RecordBatch.from_arrays([pa.array([max(f) for f in found], pa.int64()), pa.array([min(f) for f in found], pa.int64())],
                                                 names=["a", "b"])
    return run


def _walk(batches):
    """Members of every signature with two ids or more, with the smallest id
    of the run; ``border`` rows name the first and last run of the partition."""
    def chunks():
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WALK_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def out(sig, own, head, border):
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(own), pa.array(head), pa.array(np.full(len(sig), border))],
                                          names=["sig", "id", "head", "border"])

    last = None  # signature, id, head, alone so far
    for table in chunks():
        sig, own = (table.column(c).to_numpy() for c in (0, 1))
        if last is not None:  # the row before, so that every row has one
            sig, own = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], own])
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[fresh], own[fresh]
        start = np.ones(len(sig), bool)
        start[1:] = sig[1:] != sig[:-1]
        at = np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))
        head = own[at]
        member = ~start
        member[:-1] |= ~start[1:]
        if last is not None:
            same = at == 0
            head[same] = last[2]
            member[0] &= last[3]  # else it has been written before
        else:
            yield out(sig[:1], own[:1], own[:1], True)
        yield out(sig[member], own[member], head[member], False)
        alone = bool(start[-1]) and (len(sig) > 1 or last is None or last[3])
        last = int(sig[-1]), int(own[-1]), int(head[-1]), alone
    if last is not None:
        yield out(np.array([last[0]]), np.array([last[2]]), np.array([last[2]]), True)


def _open_groups(rows: DataFrame) -> DataFrame:
    """``key``, ``n``: groups of (``key``, ``id``, ``root``) rows in several
    components, one for each list of members."""
    member = F.xxhash64("id").cast("decimal(20,0)")
    groups = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                     F.count(F.lit(1)).alias("n"), F.sum(member).alias("list"))
    return groups.where("lo < hi").groupBy("list", "n", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n")


def _block_pairs(rows: DataFrame, whole: DataFrame, parts: int) -> DataFrame:
    """``x``, ``y``: all pairs of blocks of the groups of (``key``, ``id``, ``root``, ``n``)
    rows, members with their sketches; ``y`` is null for a block with itself."""
    blocks = (rows.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")).drop("n")
                  .join(whole.select("id", "n", "sketch"), "id")
                  .groupBy("key", "block").agg(F.collect_list(F.struct("id", "root", "n", "sketch")).alias("rows")))
    blocks = reliable_checkpoint(blocks)
    pairs = (blocks.select("key", F.col("block").alias("i"), F.col("rows").alias("x"))
                   .join(blocks.select("key", F.col("block").alias("j"), F.col("rows").alias("y")), "key").where("i <= j"))
    return pairs.withColumn("y", F.when(F.col("i") < F.col("j"), F.col("y"))).repartition(parts, "key", "i", "j").select("x", "y")


def _links(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The (``a``, ``b``) pairs whose whole sets are similar."""
    side = lambda c: whole.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("shingles").alias("s" + c))
    both = F.size(F.array_intersect("sa", "sb"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return (pairs.join(side("a"), "a").join(side("b"), "b").where(near)
                 .where(F.when(near, 100 * both >= percent * (F.col("na") + F.col("nb") - both))).select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       percent: int = 90) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (smallest id reachable by
    links, its own if none), a row per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = reliable_checkpoint(docs.mapInArrow(_sets(shingle, percent, False), "id long, n long, k1 long, k2 long, sigs array<long>"))
    real = sets.where("id is not null and n > 0")
    # equal sets: each id to the smallest one with its set
    least = real.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("most")).where("rep < most")
    copies = reliable_checkpoint(real.select("id", "n", "k1", "k2").join(least, ["n", "k1", "k2"]).where("id <> rep").select("id", "rep").distinct())

    def by_set(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = (rows.join(copies.select(F.col("id").alias(c), "rep"), c, "left")
                        .withColumn(c, F.coalesce("rep", c)).drop("rep"))
        return rows

    parts = shuffle_partitions(spark)
    with arrow_rows(spark, 16384):
        walked = reliable_checkpoint(
            real.select(F.explode("sigs").alias("sig"), "id").repartitionByRange(parts, "sig", "id")
                .sortWithinPartitions("sig", "id").mapInArrow(_walk, "sig long, id long, head long, border boolean"))
    border = walked.where("border").select("sig", "head").distinct()
    ends = border.groupBy("sig").agg(F.min("head").alias("least"), F.max("head").alias("most")).where("least < most")
    ends = border.join(ends, "sig").select("sig", F.col("head").alias("id"), F.col("least").alias("head"))
    # the least of a run over several partitions has met no member of the others: a null head lets it take part below
    ends = ends.unionByName(ends.where("id = head").select("sig", "id", F.lit(None).cast("long").alias("head")))
    members = walked.where("not border").drop("border").unionByName(ends)

    pairs = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    pairs = reliable_checkpoint(by_set(pairs, "a", "b").where("a <> b")
                                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    wanted = small_side(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), 1_000_000)
    whole = reliable_checkpoint(docs.join(wanted, "id").select("id", "text")
                                    .mapInArrow(_sets(shingle, percent, True), "id long, n long, shingles array<long>, sketch binary, sigs array<long>"))
    links = _links(pairs, whole, percent)
    first = reliable_checkpoint(components(links.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")))))

    # groups whose members, but for the one that all have met, lie in several components
    other = by_set(members.where("head is null or id <> head").select(F.col("sig").alias("key"), "id").distinct(), "id").distinct()
    other = reliable_checkpoint(other.join(first.withColumnRenamed("node", "id"), "id", "left")
                                     .select("key", "id", F.coalesce("root", "id").alias("root")))
    opened = reliable_checkpoint(_open_groups(other))
    rows = other.join(opened, "key")
    second = (rows.where(F.col("n") > CUT).join(whole.select("id", "sigs"), "id")
                  .select("key", "id", "root", F.explode("sigs").alias("sig"))
                  .select(F.xxhash64("key", "sig").alias("key"), "id", "root").distinct())
    second = reliable_checkpoint(second)
    rows = (rows.where(F.col("n") <= CUT)
                .unionByName(second.join(_open_groups(second), "key").select(rows.columns)))
    with arrow_rows(spark, 64):
        near = reliable_checkpoint(_block_pairs(rows, whole, parts).mapInArrow(_may_link(percent), "a long, b long").distinct())
    late = _links(near, whole, percent)
    found = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    return (sets.select("id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "id"), "id", "left")
                .select("id", "n_shingles", F.coalesce("root", "id").alias("component_id")))
