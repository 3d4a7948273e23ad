"""Language id: Viterbi against plain dynamic programming, held-out accuracy."""
import random

import numpy as np
import pytest

from ledgerline.llm import langid
from ledgerline.llm.common import prepare


def plain_viterbi(scores, switch):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        best = int(value.argmax())
        jump = value[best] - switch
        back.append(np.where(jump > value, best, np.arange(len(value))))
        value = np.maximum(value, jump) + s
    state = int(value.argmax())
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1], float(value.max())


def path_value(scores, labels, switch):
    return sum(s[k] for s, k in zip(scores, labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


def test_blocked_viterbi_is_viterbi(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 4)
    rng = np.random.default_rng(5)
    lab = langid.Labeller({"langs": ["a", "b", "c"], "scores": {}, "base": np.zeros(3), "scripts": {}}, 2.0)
    sizes = np.array([0, 1, 3, 4, 5, 17, 64, 0, 30])
    scores = -rng.exponential(2.0, (sizes.sum(), 3))
    labels, at = lab.viterbi(scores, sizes), 0
    for n in sizes:
        if n:
            want, value = plain_viterbi(scores[at:at + n], 2.0)
            assert path_value(scores[at:at + n], labels[at:at + n], 2.0) == pytest.approx(value)
            assert labels[at:at + n].tolist() == want
        at += n


SYLL = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "ein", "ö"], "ru": ["ко", "ст", "ни", "ва"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLL[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_spans_and_cases(spark):
    prepare(spark)
    rng = random.Random(6)
    rows = [(i, text(rng, lang, 40), lang) for i, lang in enumerate(["en", "de", "ru"] * 60)] + [(900, None, "en"), (901, "x", None)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en", "ru"]
    mixed = text(rng, "en", 20) + ". " + text(rng, "ru", 30) + " 123 " + text(rng, "de", 10)
    docs = spark.createDataFrame([(1, mixed, 0), (2, None, 0), (3, "", 0), (4, "12 34 _", 0), (5, text(rng, "de", 30000), 0),
                                  (1, mixed, 0)], "doc_id long, text string, score int")
    got = langid.identify(docs, model).collect()
    first = got[0]["_lang"]
    assert [s.lang for s in first.spans] == ["en", "ru", "de"]
    assert [(s.first_word, s.end_word) for s in first.spans] == [(0, 20), (20, 50), (50, 60)]
    assert got[5]["_lang"] == first
    assert [(g["_lang"].lang, g["_lang"].score) for g in got[1:4]] == [("und", 0.0)] * 3
    assert got[4]["_lang"].lang == "de" and got[4]["_lang"].score > 0.99
    nothing = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(docs, nothing).first()["_lang"].lang == "und"
    assert langid.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from ledgerline.llm.queries import QUERIES
    got = QUERIES["op10_viterbi_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 100
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.9


def test_rare_language_is_learnt(spark):
    """One row in twenty thousand is enough to predict its language."""
    prepare(spark)
    common = spark.range(20000).selectExpr("id AS doc_id", "concat('the quick house and this was there number', id % 7) AS text", "'en' AS lang")
    rare = spark.createDataFrame([(30000, "żółty źrebię chrząszcz brzmi trzcinie szczęście", "pl")], "doc_id long, text string, lang string")
    model = langid.learn(common.unionByName(rare))
    assert model["langs"] == ["en", "pl"]
    got = langid.identify(spark.createDataFrame([(1, "chrząszcz w trzcinie"), (2, "this was the house")], "doc_id long, text string"), model)
    assert {r.doc_id: r._lang.lang for r in got.collect()} == {1: "pl", 2: "en"}
