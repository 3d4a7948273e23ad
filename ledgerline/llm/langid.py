"""Language id of mixed-language text.

Scripts (Unicode ranges) narrow the languages of a word; character trigrams
score what is left; Viterbi over the words of a text, with a penalty for each
switch, labels spans.  The text's language is the one with most letters.

The model is learnt from labelled rows: of every language a hash sample of about
``LANG_ROWS`` of them (the documented bound of the fit), of which the
``LANG_FEATURES`` most frequent trigrams are kept, so a rare language is learnt as
well as a frequent one, however large the table is.

Defined cases: a null or letterless text, and any text if nothing was learnt,
is ``und`` with score 0 and no spans; ties go to the first language by name;
repeated rows repeat; extra columns pass through, own columns are under
``_lang``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import small_side
from ledgerline.operators.stats import top_n_per_key
from ledgerline.session import reliable_checkpoint

LANG_ROWS = 1500
LANG_FEATURES = 50_000
SMOOTH = 0.5
SWITCH = 8.0
BLOCK = 128
CACHE_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+")
# first and last code point of the ranges of each script (Unicode blocks)
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
           ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F),
           ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF),
           ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def script(word: str) -> str:
    c = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "other")


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + 3] for i in range(len(w) - 2)]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          lang_rows: int = LANG_ROWS) -> dict:
    """Model from the rows with a text and a language."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = rows.groupBy(F.col(lang_col).alias("_ll10_lang")).agg((F.lit(float(lang_rows)) / F.count(F.lit(1))).alias("_ll10_share"))
    rows = rows.join(small_side(share, 100_000), F.col(lang_col) == F.col("_ll10_lang")).where(
        F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.col("_ll10_share") * (1 << 30))

    def count(batches):
        for batch in batches:
            grams: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in WORD.findall(text.lower()):
                    grams[lang, "script:" + script(word)] += 1
                    for g in trigrams(word):
                        grams[lang, g] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()),
                                              pa.array([k[1] for k in grams], pa.string()),
                                              pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = reliable_checkpoint(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
                                     .mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    scripts = counts.where(F.col("gram").startswith("script:")).collect()
    top = top_n_per_key(counts.where(~F.col("gram").startswith("script:")), "lang", [F.col("n").desc(), F.col("gram")], LANG_FEATURES).collect()
    langs = sorted({r.lang for r in scripts})
    at = {x: i for i, x in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    for r in top:
        table.setdefault(r.gram, np.zeros(len(langs)))[at[r.lang]] = r.n
    total = sum(table.values()) if table else np.zeros(len(langs))
    base = np.log(SMOOTH) - np.log(total + SMOOTH * (len(table) + 1)) if langs else total
    scores = {g: np.log(v + SMOOTH) - np.log(total + SMOOTH * (len(table) + 1)) for g, v in table.items()}
    seen: dict[str, np.ndarray] = {}
    for r in scripts:
        seen.setdefault(r.gram.removeprefix("script:"), np.zeros(len(langs)))[at[r.lang]] = r.n
    # a language uses a script if at least one in a thousand of its words does
    words = sum(seen.values()) if seen else np.zeros(len(langs))
    allowed = {s: v > 0.001 * words for s, v in seen.items()}
    return {"langs": langs, "scores": scores, "base": base, "scripts": allowed}


class Labeller:
    def __init__(self, model: dict, switch: float = SWITCH):
        self.langs, self.scripts = model["langs"], model["scripts"]
        self.gram_row = {g: i for i, g in enumerate(model["scores"])}
        self.gram_scores = np.array([*model["scores"].values(), model["base"]]).reshape(len(self.gram_row) + 1, len(self.langs))
        self.any = np.ones(len(self.langs), bool)
        self.switch = switch
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log scores of the languages for each word, shifted so that the best is 0."""
        get, none = self.gram_row.get, len(self.gram_row)
        rows, counts = [], []
        for w in words:
            w = f"^{w}$"
            n = len(w) - 2
            rows.extend([get(w[i:i + 3], none) for i in range(n)])
            counts.append(n)
        scores = np.add.reduceat(self.gram_scores[rows], np.cumsum(counts) - counts, axis=0)
        allowed = np.array([self.allowed(script(w)) for w in words])
        scores = np.where(allowed, scores, scores.max(axis=1, keepdims=True) - 50.0)
        return scores - scores.max(axis=1, keepdims=True)

    def allowed(self, name: str) -> np.ndarray:
        """Languages that use a script; all of them if none is known to."""
        own = self.scripts.get(name)
        return own if own is not None and own.any() else self.any

    def _lookup(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.index))
        if new:
            k = len(self.index)
            self.index.update(zip(new, range(k, k + len(new))))
            while k + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k:k + len(new)] = self.word_scores(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best label of every word of texts laid end to end.

        Texts are cut into blocks of ``BLOCK`` words, each solved for every
        state at its start, all blocks at once; the blocks of a text are then
        chained and traced back.  This equals Viterbi over whole texts.
        """
        langs, n = scores.shape[1], len(scores)
        blocks = -(-sizes // BLOCK)
        text_of = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        value = np.where(np.eye(langs, dtype=bool)[None], 0.0, -np.inf).repeat(len(starts), 0)  # block, state before, state now
        stay = np.arange(langs, dtype=np.int8)
        back = np.empty((BLOCK, len(starts), langs, langs), np.int8)
        for t in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > t)
            v = value[on]
            best = v.argmax(axis=2)
            top = np.take_along_axis(v, best[:, :, None], 2) - self.switch
            jump = top > v
            back[t, on] = np.where(jump, best[:, :, None], stay)
            value[on] = np.where(jump, top, v) + scores[starts[on] + t][:, None, :]
        # a block's first step may already switch away from the state before it; a text starts in any state freely
        enter = np.empty((len(starts), langs), np.int8)
        total = np.zeros((len(sizes), langs))
        order = [np.flatnonzero(nth == k) for k in range(int(blocks.max(initial=0)))]
        for own in order:
            reach = total[text_of[own]][:, :, None] + value[own]
            enter[own] = reach.argmax(axis=1)
            total[text_of[own]] = reach.max(axis=1)
        state = total.argmax(axis=1)
        last = np.empty(len(starts), np.int64)
        for own in reversed(order):
            last[own] = state[text_of[own]]
            state[text_of[own]] = enter[own, last[own]]
        first = enter[np.arange(len(starts)), last]
        labels, now = np.empty(n, np.int8), last.copy()
        for t in range(int(length.max(initial=0)) - 1, -1, -1):
            on = np.flatnonzero(length > t)
            labels[starts[on] + t] = now[on]
            now[on] = back[t, on, first[on], now[on]]
        return labels

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, share of letters, spans (language, first word, end word)) of each text."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        parts = [WORD.findall((t or "").lower()) if self.langs else [] for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        words = [w for p in parts for w in p]
        rows = self._lookup(words)
        labels = self.viterbi(self.rows[rows], sizes) if words else np.zeros(0, np.int8)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        out, at = [], 0
        for n in sizes:
            if not n:
                out.append(("und", 0.0, []))
                continue
            own = labels[at:at + n]
            share = np.bincount(own, letters[at:at + n], len(self.langs))
            best = int(share.argmax())
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            edges = [0, *cut.tolist(), int(n)]
            out.append((self.langs[best], float(share[best] / share.sum()),
                        [(self.langs[own[a]], a, b) for a, b in zip(edges, edges[1:])]))
            at += n
        return out


_LABELLERS: dict = {}
_TYPE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                      T.StructField("spans", T.ArrayType(T.StructType([
                          T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()),
                          T.StructField("end_word", T.IntegerType())])))])
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))


def identify(docs: DataFrame, model: dict, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``_lang``: struct(lang, score, spans of words)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        if key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(shared.value, switch)
        found = _LABELLERS[key].label(texts.to_pylist())
        spans = [[dict(zip(("lang", "first_word", "end_word"), s)) for s in f[2]] for f in found]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                           pa.array([f[1] for f in found], pa.float64()),
                                           pa.array(spans, _SPANS)], names=["lang", "score", "spans"])

    return docs.withColumn("_lang", F.arrow_udf(run, _TYPE)(F.col(text_col).cast("string")))
