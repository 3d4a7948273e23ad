"""Phrase collocations by SON partitioning.

Phrases are runs of up to ``longest`` words inside a piece (text between
punctuation marks or line ends), counted per language.

1. *Pack.*  Texts are packed by language into compressed chunks of about
   ``CHUNK_BYTES``, written once, and dealt to ``support // 2`` shards by a hash,
   so that the support lowered to a shard's share of all words stays about two.
2. *Mine each shard completely.*  Every chunk counts all its phrases and sends
   hashes and counts to hash buckets.  A bucket holds one hash range of all
   shards and counts each shard for itself; a phrase with ``support``
   occurrences reaches the lowered support, ceil(support x share), in one shard
   at least.  The union of the locally frequent hashes, less those whose shards
   sum to less than ``support``, goes back to the chunks as one bit a phrase.
   (Equal hashes of different phrases only add candidates.)
3. *Count the candidates exactly.*  Tasks count the phrases with a bit as
   words, over all shards, and send them packed to their buckets; sums below
   ``support`` fall away there.
4. *Score.*  Joins of the counted phrases with those of their parts.

No candidate list reaches the driver or is broadcast; a bucket's size does not
depend on how frequent a phrase is, as every chunk sends it once.

Defined cases: a null text is empty; a null language is ``und``; words keep
their bytes but for A-Z, in lower case; repeated rows count again; a language
without candidates has no rows; an empty table gives an empty result; other
columns are not kept.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import as_bytes
from ledgerline.llm.substring import _mix, bucket_of
from ledgerline.operators.stats import top_n_per_key
from ledgerline.session import reliable_checkpoint, shuffle_partitions

CHUNK_BYTES = 2 << 20
BUCKET_WORDS = 1 << 20  # for the number of buckets
HELD = 400_000  # phrases that a task counts before it emits
_STOP = bytes(46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))  # all marks become full stops
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def normal(raw: bytes) -> bytes:
    """Lower case, pieces between single full stops."""
    return raw.lower().translate(_STOP).replace(b".", b" . ")


class Unit:
    """Distinct phrases of one chunk (of one language): per length the number
    of occurrences, a place where each starts and a 64-bit hash."""

    def __init__(self, text: bytes, lang: str, longest: int):
        self.tokens = text.split()
        number = defaultdict(count(1).__next__)
        number[b"."] = 0
        word = np.fromiter(map(number.__getitem__, self.tokens), np.int64, len(self.tokens))
        salt = xxhash.xxh64_intdigest(lang.encode())
        own = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in number), np.uint64, len(number))
        self.levels = []
        inner = np.flatnonzero(word > 0)
        run = np.zeros(len(word) + 1, np.int64)  # words from here to the end of the piece
        stops = np.append(np.flatnonzero(word == 0), len(word))
        run[inner] = stops[np.searchsorted(stops, inner)] - inner
        start, at, state = inner, word, own
        for size in range(1, longest + 1):
            if size > 1:
                start = start[run[start] >= size]
            code = at[start] if size == 1 else at[start] * len(own) + word[start + size - 1]
            uniq, place, inverse, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            state = own[uniq] if size == 1 else _mix(state[uniq // len(own)] * _M[0] + own[uniq % len(own)] * _M[1])
            at = np.zeros(len(word), np.int64)
            at[start] = inverse
            self.levels.append((start[place], times, state))

    def phrases(self):
        """Hashes and counts of all phrases in the order of their hashes, and that order."""
        state = _mix(np.concatenate([s * _M[1] + np.uint64(k) for k, (_, _, s) in enumerate(self.levels)]))
        times = np.concatenate([t for _, t, _ in self.levels])
        order = np.argsort(state, kind="stable")
        return state[order], times[order], order

    def words(self, chosen: np.ndarray):
        """(phrases, occurrences) of the phrases at the places ``chosen`` in the order of :meth:`phrases`."""
        sizes = np.repeat(np.arange(1, len(self.levels) + 1), [len(p) for p, _, _ in self.levels])
        place, times = (np.concatenate([x[k] for x in self.levels])[chosen] for k in (0, 1))
        tokens = self.tokens
        return [b" ".join(tokens[p:p + n]) for p, n in zip(place.tolist(), sizes[chosen].tolist())], times.tolist()


def _cut(text: bytes):
    """Parts of about ``CHUNK_BYTES`` or less of a normal text; no piece is cut."""
    while len(text) > CHUNK_BYTES:
        at = text.rfind(b" . ", 0, CHUNK_BYTES)
        at = at if at > 0 else text.find(b" . ", CHUNK_BYTES)
        if at < 0:
            break
        yield text[:at]
        text = text[at + 3:]
    if text:
        yield text


def _pack(batches):
    from pyspark import TaskContext

    base, k, size = TaskContext.get().partitionId() << 32, 0, 0
    held: dict[str, list] = {}

    def rows():
        packer = zstandard.ZstdCompressor(3)
        langs = sorted(held)
        texts = [b" . ".join(held[c]) for c in langs]
        words = [len(t.split()) - t.split().count(b".") for t in texts]
        return pa.RecordBatch.from_arrays([
            pa.array([base + k + j for j in range(len(langs))], pa.int64()), pa.array(langs, pa.string()),
            pa.array(words, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary())],
            names=["chunk", "lang", "words", "data"])

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            for part in _cut(normal(raw or b"")):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield rows()
                    held, size, k = {}, 0, k + len(held)
    if held:
        yield rows()


def _units(batches, longest: int):
    for batch in batches:
        for j in range(batch.num_rows):
            row = batch.slice(j, 1).to_pylist()[0]
            yield row, Unit(zstandard.ZstdDecompressor().decompress(row["data"]), row["lang"], longest)
        pa.default_memory_pool().release_unused()


def _edges(state: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(state, buckets), np.arange(buckets + 1))


def _emit(buckets: int, longest: int):
    """Hashes and counts of all phrases of a chunk, a row per bucket."""
    def run(batches):
        for row, unit in _units(batches, longest):
            state, times, _ = unit.phrases()
            edges = _edges(state, buckets)
            used = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            low, times = state.astype(np.uint32), times.astype(np.uint32)
            packer = zstandard.ZstdCompressor(1)
            yield pa.RecordBatch.from_arrays([
                pa.array(used, pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()), pa.array([row["shard"]] * len(used), pa.int32()),
                pa.array([low[edges[b]:edges[b + 1]].tobytes() for b in used], pa.binary()),
                pa.array([packer.compress(times[edges[b]:edges[b + 1]].tobytes()) for b in used], pa.binary())],
                names=["bucket", "chunk", "shard", "hashes", "times"])
    return run


def _mine(lowered: list[int], support: int):
    """Which phrases of each chunk are frequent in some shard (and may be in all)."""
    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in t["hashes"].to_pylist()]
        sizes = np.array([len(p) for p in parts])
        unpack = zstandard.ZstdDecompressor()
        times = np.concatenate([np.frombuffer(unpack.decompress(x), np.uint32) for x in t["times"].to_pylist()])
        shard = np.repeat(t["shard"].to_numpy().astype(np.uint64), sizes)
        low = np.concatenate(parts)
        key = low.astype(np.uint64) * np.uint64(len(lowered)) + shard
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        local = np.add.reduceat(times[order].astype(np.int64), heads)  # one shard's count of one hash
        own = ordered[heads]
        frequent = local >= np.array(lowered)[(own % np.uint64(len(lowered))).astype(np.int64)]
        own //= np.uint64(len(lowered))
        firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        union = np.logical_or.reduceat(frequent, firsts) & (np.add.reduceat(local, firsts) >= support)
        found = own[firsts][union].astype(np.uint32)  # ascending
        spot = np.searchsorted(found, low)
        spot[spot == len(found)] = 0
        bits = found[spot] == low if len(found) else np.zeros(len(low), bool)
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"],
                         "bits": pa.array([np.packbits(b).tobytes() for b in np.split(bits, cuts)], pa.binary())})
    return run


def _count(buckets: int, longest: int):
    """Counts of the candidate phrases, combined over the chunks of a task, a row per bucket and language."""
    def run(batches):
        held, size = {}, 0

        def rows():
            packer = zstandard.ZstdCompressor(3)
            keys = list(held)
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.string()),
                pa.array([packer.compress(b"\n".join(held[k])) for k in keys], pa.binary()),
                pa.array([np.fromiter(held[k].values(), np.int64).tobytes() for k in keys], pa.binary())],
                names=["bucket", "lang", "phrases", "times"])

        for row, unit in _units(batches, longest):
            state, _, order = unit.phrases()
            edges = _edges(state, buckets)
            for f in row["flags"] or []:
                lo, hi = edges[f["bucket"]], edges[f["bucket"] + 1]
                bits = np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=hi - lo)
                if bits.any():
                    own = held.setdefault((f["bucket"], row["lang"]), {})
                    size -= len(own)
                    for phrase, n in zip(*unit.words(order[lo:hi][bits.astype(bool)])):
                        own[phrase] = own.get(phrase, 0) + n
                    size += len(own)
            if size >= HELD:
                yield rows()
                held, size = {}, 0
        if held:
            yield rows()
    return run


def _total(support: int):
    """Exact sums of one bucket's phrases, those with ``support`` or more."""
    def run(t: pa.Table) -> pa.Table:
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for lang, phrases, times in zip(t["lang"].to_pylist(), t["phrases"].to_pylist(), t["times"].to_pylist()):
            own = sums.setdefault(lang, {})
            for phrase, n in zip(unpack.decompress(phrases).split(b"\n"), np.frombuffer(times, np.int64).tolist()):
                own[phrase] = own.get(phrase, 0) + n
        kept = [(lang, p.count(b" ") + 1, p, n) for lang, own in sums.items() for p, n in own.items() if n >= support]
        lang, size, phrase, n = zip(*kept) if kept else ((),) * 4
        return pa.table({"lang": pa.array(lang, pa.string()), "size": pa.array(size, pa.int32()),
                         "phrase": pa.array(phrase, pa.binary()).cast(pa.string()), "f": pa.array(n, pa.int64())})
    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, support: int = 10, lang_col: str = "lang",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``size``, ``phrase``, ``f``) of all phrases of 1 to ``longest``
    words with ``support`` occurrences or more, and (``lang``, ``n``): its words."""
    shards = max(1, support // 2)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    packed = reliable_checkpoint(texts.mapInArrow(_pack, "chunk long, lang string, words long, data binary"))
    packed = packed.withColumn("shard", F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int"))
    words = {s: n for s, n in packed.groupBy("shard").agg(F.sum("words")).collect()}  # a row per shard
    total = sum(words.values())
    lowered = [max(1, -(-support * words.get(s, 0) // max(total, 1))) for s in range(shards)]
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_WORDS))
    sent = packed.select("chunk", "shard", "lang", "data").mapInArrow(
        _emit(buckets, longest), "bucket int, chunk long, shard int, hashes binary, times binary")
    flags = sent.groupBy("bucket").applyInArrow(_mine(lowered, support), "chunk long, bucket int, bits binary")
    flags = reliable_checkpoint(flags.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags")))
    counted = packed.join(flags, "chunk").select("lang", "data", "flags").mapInArrow(
        _count(buckets, longest), "bucket int, lang string, phrases binary, times binary")
    counted = counted.groupBy("bucket").applyInArrow(_total(support), "lang string, size int, phrase string, f long")
    return reliable_checkpoint(counted), packed.groupBy("lang").agg(F.sum("words").alias("n"))


def _part(begin, length):
    return F.array_join(F.slice(F.col("words"), begin, length), " ")


def collocations(docs: DataFrame, top: int = 2000, longest: int = 3, support: int = 10, covered_percent: int = 50,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the
    ``top`` phrases of 2 words or more of every language.  A phrase's score is
    floor(10^6 a^2 / (l r)) of its worst cut; phrases inside a longer one with
    ``covered_percent`` of their occurrences or more are left out."""
    counted, lang_words = frequent_phrases(docs, longest, support, lang_col, text_col)
    candidates = counted.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    longer = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part(i, m))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (100 * F.col("within") < covered_percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"),
                       _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    one = lambda c, f: counted.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    score = F.expr("1000000 * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    scored = cuts.join(one("first", "l"), ["lang", "first"]).join(one("rest", "r"), ["lang", "rest"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = top_n_per_key(rows, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top, rank_col="rank")
    return ranked.join(lang_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
