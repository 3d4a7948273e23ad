"""Decontamination against a brute-force alignment of all items and texts."""
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate as dc
from ledgerline.llm.common import prepare


def edits_brute(item, text):
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (w != x), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_matches_brute_force(spark):
    prepare(spark)
    rng = random.Random(4)
    vocab = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 9, 14, 30, 70])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "?!"), items[0], (None, "w1 w2 w3")]
    texts = [None, "", " ?? "]
    for k in range(160):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if k % 2:
            words = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                if kind == 0 and len(words) > 1:
                    del words[at]
                elif kind == 1:
                    words.insert(at, rng.choice(vocab))
                else:
                    words[at] = rng.choice(vocab)
            at = rng.randint(0, len(t))
            t[at:at] = words
        texts.append(rng.choice([" ", ", ", "\n"]).join(t).title())
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.contaminated(docs, bench).select("doc_id", F.transform("_items", lambda x: x["item_id"]).alias("ids"),
                                              F.transform("_items", lambda x: x["edits"]).alias("edits")).collect()
    got = {(r.doc_id, i): e for r in out for i, e in zip(r.ids, r.edits)}
    want = {}
    for d, t in enumerate(texts):
        words = dc.WORDS.findall((t or "").lower())
        for i, it in set(items):
            iw = dc.WORDS.findall((it or "").lower())
            if iw and i is not None and (e := edits_brute(iw, words)) <= dc.budget(len(iw)):
                want[d, i] = e
    assert set(got) <= set(want)
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= set(got)
    assert len(got) >= 0.97 * len(want)


def test_empty_sides(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).first()._items == []
    assert dc.contaminated(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("words", [20, 59, 100, 128, 256, 400])
@pytest.mark.parametrize("kind", ["delete", "insert"])
def test_one_sided_edits_are_found(words, kind):
    """A fifth of the words deleted, or as many inserted: at least 19 of 20 are found."""
    rng = random.Random(words)
    items = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(words))) for i in range(20)]
    matcher = dc.Matcher(items, dc.SIMILARITY, dc.RECALL)
    found = 0
    for i, text in items:
        w = text.split()
        for at in sorted(rng.sample(range(words), dc.budget(words)), reverse=True):
            if kind == "delete":
                del w[at]
            else:
                w.insert(at, f"n{rng.randrange(5000)}")
        around = [f"v{rng.randrange(5000)}" for _ in range(300)]
        found += i in [h[0] for h in matcher.search([" ".join(around[:150] + w + around[150:])])[0]]
    assert found >= 19


def test_items_in_several_blocks(spark, monkeypatch):
    prepare(spark)
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} z") for i in range(0, 30, 3)] + [(99, None)], "doc_id long, text string")
    one = {r.doc_id: r._items for r in dc.contaminated(docs, bench).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    assert {r.doc_id: r._items for r in dc.contaminated(docs, bench).collect()} == one
    assert all([x.item_id for x in found] == ([i] if i < 99 else []) for i, found in one.items())
