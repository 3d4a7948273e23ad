"""Collocations against brute force."""
import random
import re

import numpy as np
import pytest

from ledgerline.llm import phrases
from ledgerline.llm.common import prepare


def brute_counts(rows):
    found, words = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] = words.get(lang, 0) + len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    key = lang, " ".join(w[i:i + size])
                    found[key] = found.get(key, 0) + 1
    return found, words


def brute(rows, top=2000, support=10):
    f, words = brute_counts(rows)
    out = []
    for lang in words:
        best = []
        cand = {p.split(" ") and p: n for (c, p), n in f.items() if c == lang and " " in p and n >= support}
        for phrase, a in cand.items():
            w = phrase.split(" ")
            if any(len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " and 100 * b >= 50 * a for q, b in cand.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
                cuts.append((10 ** 6 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            best.append((-score, -a, phrase.encode(), phrase, a, left, right))
        out += [(lang, r + 1, p, a, x, y, words[lang], -s) for r, (s, _, _, p, a, x, y) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(300)] + ["É", "é", "Ab-c", "x\x00y", "naïve"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            words[3:3] = rng.choice([["new", "york", "city"], ["ad", "hoc"], ["vice", "VERSA"]])
        rows.append((rng.choice(["en", "de", None, "en"]), "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "!? "]) for w in words)))
    return rows + [("en", None), ("en", ""), ("fr", "a b"), ("xx", " . "), ("en", "w1 w1 w1 w1 " * 4000), ("de", "long piece " * 3000 + ". end")]


@pytest.mark.parametrize("top", [2000, 4])
def test_matches_brute_force(spark, monkeypatch, top):
    rows = corpus(250, 3)
    prepare(spark)
    df = spark.createDataFrame([(c, t, 5) for c, t in rows], "lang string, text string, size int").repartition(6)
    got = sorted(tuple(r) for r in phrases.collocations(df, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, top)


def test_all_frequent_phrases_are_counted(spark):
    rows = corpus(150, 4)
    prepare(spark)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for support in (1, 7):
        found, words = phrases.frequent_phrases(df, 3, support)
        want, total = brute_counts(rows)
        assert {(r.lang, r.phrase): r.f for r in found.collect()} == {k: n for k, n in want.items() if n >= support}
        assert {r.lang: r.n for r in words.collect() if r.n} == {k: n for k, n in total.items() if n}


def test_longer_phrases(spark):
    prepare(spark)
    df = spark.createDataFrame([("en", "a b c d e. a b c d e. a b c. b c")], "lang string, text string")
    found, _ = phrases.frequent_phrases(df, 5, 2)
    got = {r.phrase: r.f for r in found.collect()}
    assert got["a b c d e"] == 2 and got["b c"] == 4 and got["a b c"] == 3 and len(got) == 15
    assert [r.phrase for r in phrases.collocations(df, longest=5, support=2).collect()] == ["a b c d e"]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    text = b" . ".join(b"word%d and more" % i for i in range(50)) + b" . " + b"x " * 200 + b" . end"
    parts = list(phrases._cut(text))
    assert len(parts) > 5 and b" . ".join(parts) == text


def test_shards_lose_no_frequent_hash():
    import pyarrow as pa
    import zstandard

    rng = np.random.default_rng(2)
    shard = [0, 1, 1, 0]
    counts = [{int(h): int(n) for h, n in zip(rng.choice(50, 30, replace=False), rng.integers(1, 9, 30))} for _ in shard]
    table = pa.table({
        "bucket": pa.array([0] * 4, pa.int32()), "chunk": pa.array(range(4)), "shard": pa.array(shard, pa.int32()),
        "hashes": [np.array(sorted(c), np.uint32).tobytes() for c in counts],
        "times": [zstandard.compress(np.array([c[h] for h in sorted(c)], np.uint32).tobytes()) for c in counts]})
    out = phrases._mine([5, 5], 10)(table).to_pylist()
    total = {h: sum(c.get(h, 0) for c in counts) for h in range(50)}
    for c, r in zip(counts, out):
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(c)).astype(bool)
        assert [h for h, b in zip(sorted(c), bits) if b] == [h for h in sorted(c) if total[h] >= 10]


def test_empty_table(spark):
    prepare(spark)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
