"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit check.

A document is contaminated by an item if some stretch of its words is within
``(1 - similarity)`` times the item's words in word edit distance.

Windows of the item's size are placed at every word where the q-gram lemma
allows such a match: an item of L words within k edits of a stretch shares at
least L - q + 1 - k*q of its q-grams with it, and each shared q-gram gives a
start.  (No matching window is lost by this.)  Every window is embedded by the CGK random walk
- at step j the walk writes the current word and moves on by a random bit of
(j, word) - so that few edits become few differing positions.  Each table uses
a walk of its own and samples positions of the embedding; windows that agree
with the item on all samples of a table go on to exact verification (Sellers'
alignment with free ends).  The number of tables follows from the target
recall and the collision rate of simulated edits at that length: mixed ones,
deletions only and insertions only.  Where ``MAX_TABLES`` tables do not reach the
target, as for long items, every window of the lemma is verified.

The items are the query set: they are sent to the workers in blocks of at most
``BLOCK_BYTES`` bytes, each block against all documents.  Nothing is shuffled.

Defined cases: null, empty and wordless texts match nothing; null, empty and
wordless items are ignored; repeated items (same id) count once; ties go to
the leftmost stretch; repeated rows repeat; extra columns pass through, own
columns are under ``_items``.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import reliable_checkpoint

SIMILARITY = 0.8
RECALL = 0.99
SAMPLES = 2
MAX_TABLES = 64
LONG_WORDS = 128  # longer items are verified at every window of the lemma
BLOCK_BYTES = 32 << 20
WORDS = re.compile(r"\w+")


def gram_size(words: int) -> int:
    """Largest q up to 3 for which the lemma leaves at least one shared gram."""
    edits = budget(words)
    return next(q for q in (3, 2, 1) if words - q + 1 - edits * q >= 1 or q == 1)


def budget(words: int, similarity: float = SIMILARITY) -> int:
    return int(words * (1 - similarity) + 1e-9)


def _multipliers(table: int, steps: int) -> np.ndarray:
    return np.random.default_rng([7, table]).integers(0, 1 << 63, steps, np.uint64) << np.uint64(1) | np.uint64(1)


def embed(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: int, stop: np.ndarray | None = None) -> np.ndarray:
    """One key per window: the words at ``SAMPLES`` places of its CGK walk.
    A window that ends early (``stop``) goes on with empty words."""
    spots = np.random.default_rng([11, table]).random(SAMPLES)
    places = (spots[None, :] * 2 * lengths[:, None]).astype(np.int64)  # the walk passes L words in about 2 L steps
    steps = int(places.max()) + 1 if len(places) else 0
    mult = _multipliers(table, max(steps, 1))
    at = starts.astype(np.int64).copy()
    stop = starts + lengths if stop is None else stop
    key = np.zeros(len(starts), np.uint64)
    for j in range(steps):
        inside = at < stop
        word = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        for s in range(SAMPLES):
            take = places[:, s] == j
            if take.any():
                key[take] += (word[take] ^ np.uint64(s + 1)) * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * s))
        at += inside & ((word * mult[j]) >> np.uint64(63)).astype(bool)
    return key


def _edited(row, k: int, kinds, rng) -> list:
    """(word, its place in ``row`` or -1) after ``k`` random edits of the given kinds (0 delete, 1 insert, 2 replace)."""
    b = [(w, i) for i, w in enumerate(row)]
    for _ in range(k):
        kind, at = kinds[int(rng.integers(len(kinds)))], int(rng.integers(max(len(b), 1)))
        if kind == 0 and b:
            del b[at]
        elif kind == 1:
            b.insert(at, (np.uint64(rng.integers(1, 1 << 62)), -1))
        elif b:
            b[at] = np.uint64(rng.integers(1, 1 << 62)), -1
    return b


@lru_cache(maxsize=None)
def tables_for(words: int, similarity: float, recall: float) -> int:
    """Tables that reach ``recall`` for items of about ``words`` words with the
    largest allowed number of edits, be they mixed, deletions or insertions
    only (simulated); 0 if ``MAX_TABLES`` do not, so that the windows of the
    q-gram lemma are verified without a filter."""
    if words > LONG_WORDS:
        return 0
    rng, n, k, need = np.random.default_rng([3, words]), 200, budget(words, similarity), 1
    a = rng.integers(1, 1 << 62, (n, words), np.uint64)
    own = np.arange(n) * words, np.full(n, words)
    width, q = 3 * words + 2 * k, gram_size(words)  # each stretch stands in other words
    for kinds in ((0, 1, 2), (0,), (1,)):
        text = rng.integers(1, 1 << 62, (n, width), np.uint64)
        rows, starts = [], []
        for i, (row, t) in enumerate(zip(a, text)):
            b = _edited(row, k, kinds, rng)
            t[words:words + len(b)] = [w for w, _ in b]
            place = [o for _, o in b]
            # every gram that has survived places a window, moved by the words that came or went before it
            moves = {p - place[p] for p in range(len(b) - q + 1) if place[p] >= 0 and place[p:p + q] == list(range(place[p], place[p] + q))}
            rows += [i] * len(moves)
            starts += [i * width + words + m for m in sorted(moves)]
        rows, starts = np.array(rows, np.int64), np.array(starts, np.int64)
        met = np.zeros(n, bool)
        for t in range(MAX_TABLES):
            met[rows[embed(text.ravel(), starts, np.full(len(starts), words), t) == embed(a.ravel(), *own, t)[rows]]] = True
            if met.mean() >= recall:
                need = max(need, t + 1)
                break
        else:
            return 0
    return need


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, begin, end) of the stretch of ``text`` closest to ``item``; leftmost of the best."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), steps.copy()
    for i, w in enumerate(item, 1):
        diag = np.concatenate([[i], cost[:-1] + (text != w)])
        new, src = diag, np.concatenate([[0], begin[:-1]])
        up = cost + 1
        better = up < new
        new, src = np.where(better, up, new), np.where(better, begin, src)
        # insertions: running minimum of new - position
        low = np.minimum.accumulate(new - steps)
        which = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        cost, begin = low + steps, src[which]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def tables_of(lengths: list[int], similarity: float, recall: float) -> dict[int, int]:
    """Tables for each length, simulated at the next multiple of eight."""
    return {n: tables_for(-(-n // 8) * 8, similarity, recall) for n in set(lengths) if n}


class Matcher:
    """The items of one block, ready to be searched in batches of texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, tables: dict[int, int] | None = None):
        self.similarity = similarity
        self.items = []
        for item_id, text in sorted({(i, t) for i, t in items if t}):
            words = self.words(text)
            if len(words):
                self.items.append((item_id, words))
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = np.array([budget(n, similarity) for n in self.length], np.int64)
        grams: dict[int, list] = {}
        for k, (_, words) in enumerate(self.items):
            q = gram_size(len(words))
            for at, g in enumerate(self.grams(words, q)):
                grams.setdefault(q, []).append((int(g), k, at))
        self.index = {}
        for q, rows in grams.items():
            rows.sort()
            g = np.array([r[0] for r in rows], np.uint64)
            mask = np.zeros(1 << 22, bool)
            mask[(g >> np.uint64(42)).astype(np.int64)] = True
            self.index[q] = (mask, g, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.need = np.array([max(1, n - gram_size(n) + 1 - e * gram_size(n)) for n, e in zip(self.length, self.edits)])
        tables = tables_of(self.length.tolist(), similarity, recall) if tables is None else tables
        self.tables = np.array([tables[n] for n in self.length.tolist()], np.int64)
        self.keys = {}

    @staticmethod
    def words(text: str) -> np.ndarray:
        # the built-in hash: items and texts are hashed by the same worker process
        found = WORDS.findall(text.lower())
        return np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)

    @staticmethod
    def grams(words: np.ndarray, q: int) -> np.ndarray:
        n = max(0, len(words) - q + 1)
        g = words[:n].copy()
        for j in range(1, q):
            g = g * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
        g ^= g >> np.uint64(29)
        return g * np.uint64(0xBF58476D1CE4E5B9)

    def item_key(self, item: int, table: int) -> np.uint64:
        if (item, table) not in self.keys:
            words = self.items[item][1]
            self.keys[item, table] = embed(words, np.array([0]), np.array([len(words)]), table)[0]
        return self.keys[item, table]

    def _windows(self, words, doc_of):
        """(start, item) windows allowed by the q-gram lemma, starts inside the document."""
        at, item, start = [], [], []
        for q, (mask, grams, owner, offset) in self.index.items():
            g = self.grams(words, q)
            p = np.flatnonzero(mask[(g >> np.uint64(42)).astype(np.int64)])
            p = p[doc_of[p] == doc_of[p + q - 1]]
            lo, hi = np.searchsorted(grams, g[p], "left"), np.searchsorted(grams, g[p], "right")
            n = hi - lo
            p, first = np.repeat(p, n), np.repeat(lo, n)
            entry = first + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            at.append(p)
            item.append(owner[entry])
            start.append(p - offset[entry])
        at, item, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, item, start))
        if not len(at):
            return at, item
        # distinct text positions of a document and item, in order: a match has enough of them in a stretch
        spots, back = np.unique(np.stack([doc_of[at] * len(self.items) + item, at]), axis=1, return_inverse=True)
        own = spots[0] % len(self.items)
        need, room = self.need[own], self.length[own] + self.edits[own]
        far = np.arange(len(own)) + need - 1
        full = far < len(own)
        far = np.minimum(far, len(own) - 1)
        full &= (spots[0][far] == spots[0]) & (spots[1][far] - spots[1] < room)
        cover = np.zeros(len(own) + 1, np.int64)
        cover[:-1] += full
        np.add.at(cover, np.flatnonzero(full) + need[full], -1)
        enough = (np.cumsum(cover[:-1]) > 0)[back.ravel()]
        at, item, start = at[enough], item[enough], start[enough]
        doc = doc_of[at]
        first = np.searchsorted(doc_of, doc, "left")
        windows = np.unique(np.stack([np.maximum(start, first), item]), axis=1)
        return windows[0], windows[1]

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int, float]]]:
        """Per text: (item id, first word, end word, edits, similarity) of each item found."""
        out = [[] for _ in texts]
        parts = [self.words(t or "") for t in texts]
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(words) or not self.items:
            return out
        sizes = np.array([len(p) for p in parts])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        doc_of = np.repeat(np.arange(len(parts)), sizes)
        start, item = self._windows(words, doc_of)
        if not len(start):
            return out
        last = edges[doc_of[start] + 1]
        size = np.minimum(self.length[item], last - start)
        hit = self.tables[item] == 0
        for t in range(int(self.tables[item].max())):
            todo = np.flatnonzero(~hit & (self.tables[item] > t))
            if not len(todo):
                break
            keys = np.array([self.item_key(i, t) for i in item[todo]], np.uint64)
            # walks cover the window at the item's length even where the text ends earlier
            own = embed(words, start[todo], self.length[item[todo]], t, start[todo] + size[todo])
            hit[todo[own == keys]] = True
        # windows of one document and item that touch are aligned as one stretch
        hits = np.flatnonzero(hit)
        hits = hits[np.lexsort((start[hits], item[hits], doc_of[start[hits]]))]
        at = 0
        while at < len(hits):
            doc, i = int(doc_of[start[hits[at]]]), int(item[hits[at]])
            e, lo = int(self.edits[i]), int(start[hits[at]])
            stop = lo + int(size[hits[at]])
            at += 1
            while at < len(hits) and item[hits[at]] == i and doc_of[start[hits[at]]] == doc and start[hits[at]] <= stop + 2 * e:
                stop = max(stop, int(start[hits[at]] + size[hits[at]]))
                at += 1
            lo, stop = max(int(edges[doc]), lo - e), min(int(edges[doc + 1]), stop + e)
            edits, b, end = align(self.items[i][1], words[lo:stop])
            if edits <= e:
                out[doc].append((self.items[i][0], lo + b - int(edges[doc]), lo + end - int(edges[doc]), edits,
                                 1 - edits / len(self.items[i][1])))
        return [self._best(x) for x in out]

    @staticmethod
    def _best(found):
        """One hit per item: fewest edits, then leftmost."""
        best = {}
        for h in found:
            if h[0] not in best or (h[3], h[1]) < (best[h[0]][3], best[h[0]][1]):
                best[h[0]] = h
        return sorted(best.values())


_HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.IntegerType()),
                                 T.StructField("end_word", T.IntegerType()), T.StructField("edits", T.IntegerType()),
                                 T.StructField("similarity", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32()),
                             ("edits", pa.int32()), ("similarity", pa.float64())]))


_MATCHERS: dict = {}


def _finder(shared, similarity: float, recall: float):
    """Function over an Arrow array of texts; a worker process builds the matcher of a block once."""
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(shared.value[0], similarity, recall, shared.value[1])
        names = ("item_id", "first_word", "end_word", "edits", "similarity")
        return pa.array([[dict(zip(names, h)) for h in hits] for hits in _MATCHERS[key].search(texts.to_pylist())], _ARROW)

    return run


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` with ``_items``: the items found in each text."""
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    items = items.where(F.col("t").isNotNull() & F.col("i").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    out = docs.withColumn("_items", F.array().cast(_HIT))
    for b in range(blocks):
        # one block of the query set: its expected size is at most BLOCK_BYTES
        own = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        tables = tables_of([len(WORDS.findall(t.lower())) for _, t in own], similarity, recall)
        shared = docs.sparkSession.sparkContext.broadcast((own, tables))
        finder = _finder(shared, similarity, recall)
        out = out.withColumn("_items", F.concat("_items", F.arrow_udf(finder, _HIT)(F.col(text_col).cast("string"))))
        if blocks > 1:  # a pass per block: a worker builds each matcher once, and holds one
            out = reliable_checkpoint(out)
            shared.unpersist()
    return out.withColumn("_items", F.array_sort("_items"))
