"""Ranked lexical search: term at a time, with a limit on new accumulators.

The items are the query set; documents are the whole table.

1. *Index.*  One narrow pass cuts the documents into blocks of at most
   ``BLOCK_DOCS`` rows or ``BLOCK_BYTES`` of text and writes each block's
   postings (document in the block, occurrences) of the query terms, with the
   length of every document.  The index is a table in the shared folder.
2. *Statistics.*  Document count, total length and the document frequency of
   every query term are sums over the blocks.
3. *Search.*  In every block, each item's terms are taken rarest first.  A
   posting makes an accumulator or adds to one.  Once the most that all terms
   still to come can add in this block is less than the k-th best partial
   score (of the block, or of the blocks that the task has finished), no new
   accumulator can reach the result: from there on postings only update the
   documents that have one, so their scores end exact.  A task keeps ``k``
   documents an item over all its blocks and emits them at its end.
4. *Merge.*  A salted top-k per item over at most ``k`` rows a task and item.

The items are taken in blocks of about ``QUERY_BYTES`` of text, so what is sent
to the tasks is bounded whatever the size of the query set; nothing of the
documents reaches the driver but three sums and a count per query term.

Defined cases: null and empty texts and texts without a term are no documents
(they count nowhere); an item without terms has no rows; every row of
``items`` is an item, also with an equal or null id; documents with equal ids
are documents; a null document id ranks behind all others of its score; equal
scores are ordered by id; an empty table on either side gives an empty result;
other columns are not kept.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import as_bytes
from ledgerline.operators.stats import top_n_per_key
from ledgerline.session import reliable_checkpoint

BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
QUERY_BYTES = 8 << 20
NULL_ID = (1 << 63) - 1
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII; A-Z in lower case."""
    return raw.lower().translate(_KEEP).split()


_INDEX = "ids binary, lengths binary, terms array<int>, counts array<int>, places binary, times binary, n_docs long, n_terms long"


def _index(vocabulary):
    """Blocks of the inverted index; ``vocabulary``: broadcast list of terms."""
    def run(batches):
        number = {t: k for k, t in enumerate(vocabulary.value)}
        ids, lengths, hits, size = [], [], [], 0

        def block():
            n = np.array([len(h) for h in hits], np.int64)
            term = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            place = np.repeat(np.arange(len(hits)), n)
            known = term >= 0
            # one number for (term, document), so that equal ones are counted by a sort
            pair, times = np.unique(term[known] * len(hits) + place[known], return_counts=True)
            term, counts = np.unique(pair // max(len(hits), 1), return_counts=True)
            long = np.array(lengths, np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([np.array(ids, np.int64).tobytes()]), pa.array([long.tobytes()]),
                pa.array([term.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([(pair % max(len(hits), 1)).astype(np.int32).tobytes()]), pa.array([times.astype(np.int32).tobytes()]),
                pa.array([int((long > 0).sum())], pa.int64()), pa.array([int(long.sum())], pa.int64())],
                names=[c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = terms_of(raw or b"")
                if not words:
                    continue
                if ids and (len(ids) == BLOCK_DOCS or size + len(raw) > BLOCK_BYTES):
                    yield block()
                    ids, lengths, hits, size = [], [], [], 0
                ids.append(NULL_ID if i is None else i)
                lengths.append(len(words))
                hits.append(np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)))
                size += len(raw)
        if ids:
            yield block()
    return run


class Block:
    """One block of the index with the contribution of every posting."""

    def __init__(self, row: dict, weight: np.ndarray, documents: int, total: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        norm = 25 + 75 * np.frombuffer(row["lengths"], np.int64) * documents // total
        self.place = np.frombuffer(row["places"], np.int32)
        times = np.frombuffer(row["times"], np.int32).astype(np.int64)
        terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        self.gain = np.repeat(weight[terms], counts) * (1_000_000_000 * times // (1000 * times + 8 * norm[self.place]))
        ends = np.cumsum(counts)
        most = np.maximum.reduceat(self.gain, ends - counts) if len(terms) else ends
        self.postings = {t: (e - c, e, m) for t, e, c, m in zip(terms.tolist(), ends.tolist(), counts.tolist(), most.tolist())}
        self.score = np.zeros(len(self.ids), np.int64)
        self.live = np.zeros(len(self.ids), bool)

    def search(self, terms: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of every document of the block that may be
        among the ``k`` best, and the number of accumulators made.  ``terms``:
        (term, repeats), rarest first; ``least``: the k-th best score known so far."""
        here = [(*self.postings[t], times) for t, times in terms if t in self.postings]
        rest = sum(m * times for _, _, m, times in here)
        creating, made = True, 0
        for begin, end, most, times in here:
            if creating:
                bound = least
                if made >= k:
                    bound = max(bound, int(np.partition(self.score, len(self.score) - k)[-k]))
                creating = rest >= bound
            place, gain = self.place[begin:end], self.gain[begin:end] * times
            if creating:
                self.live[place] = True
                made = int(np.count_nonzero(self.live))
            else:
                own = self.live[place]
                place, gain = place[own], gain[own]
            self.score[place] += gain
            rest -= most * times
        found = np.flatnonzero(self.live)
        score = self.score[found]
        self.score[found] = 0
        self.live[found] = False
        best = (score > 0) & (score >= least)
        return found[best], score[best], made


def _search(plan, k: int):
    """Each task's best documents per item; ``plan``: broadcast (items, weights, documents, total)."""
    def run(batches):
        items, weight, documents, total = plan.value
        best: dict = {}
        for batch in batches:
            for j in range(batch.num_rows):
                block = Block(batch.slice(j, 1).to_pylist()[0], weight, documents, total)
                for number, terms in items:
                    ids, scores = best.get(number, (np.zeros(0, np.int64),) * 2)
                    place, score, _ = block.search(terms, k, int(scores[-1]) if len(scores) == k else 0)
                    if len(place):
                        ids, scores = np.concatenate([ids, block.ids[place]]), np.concatenate([scores, score])
                        order = np.lexsort((ids, -scores))[:k]
                        best[number] = ids[order], scores[order]
        for number, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number, np.int64)), pa.array(ids), pa.array(scores)],
                                             names=["item", "id", "score"])
    return run


def _weights(frequency: dict[int, int], terms: int, documents: int) -> np.ndarray:
    ratio = lambda t: (2 * documents + 2) / (2 * frequency.get(t, 0) + 1)
    return np.array([math.floor(1000 * math.log(ratio(t))) for t in range(terms)], np.int64)


def _best_of_block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """Result rows (item, id, score) of one block of items."""
    spark = docs.sparkSession
    wanted = [terms_of((text or "").encode()) for _, text in rows]
    vocabulary = sorted({t for words in wanted for t in words})
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    index = reliable_checkpoint(docs.mapInArrow(_index(spark.sparkContext.broadcast(vocabulary)), _INDEX))
    documents, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not documents:
        return None
    seen = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts"))
    frequency = {t: n for t, n in seen.collect()}  # a row per query term of the block
    items = []
    for i, words in enumerate(wanted):
        repeats: dict = {}
        for w in words:
            repeats[number[w]] = repeats.get(number[w], 0) + 1
        items.append((i, sorted(repeats.items(), key=lambda x: (frequency.get(x[0], 0), x[0]))))
    plan = spark.sparkContext.broadcast((items, _weights(frequency, len(vocabulary), documents), documents, total))
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item long, item_id long")
    found = index.mapInArrow(_search(plan, k), "item long, id long, score long")
    ranked = top_n_per_key(found, "item", [F.col("score").desc(), F.col("id")], k, rank_col="rank")
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"),
                                             F.nullif("id", F.lit(NULL_ID)).alias("id"), "score")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``id``, ``score`` of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()  # about QUERY_BYTES
        best = _best_of_block(docs, rows, k)
        if best is not None:
            best = reliable_checkpoint(best) if blocks > 1 else best
            out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, id long, score long") if out is None else out
