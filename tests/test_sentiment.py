"""Lexicon tables with boosters and negations."""
import math

from ledgerline.operators import text as TX


def compound(s):
    return s / math.sqrt(s * s + 15.0)


def test_negation_and_boosters(spark):
    lexicon = spark.createDataFrame([("Good", 2.0, 0.5), ("good", 2.0, 0.5), ("bad", -2.0, 1.0), ("odd", None, 0.1), (None, 1.0, 1.0)],
                                    "word string, valence double, subjectivity double")
    texts = {1: "GOOD", 2: "not good", 3: "not a really good", 4: "very very good", 5: "slightly bad", 6: "no x y z good", 7: "", 8: None,
             9: "odd words", 10: "never very bad, good"}
    want = {1: 2.0, 2: -2 * 0.74, 3: -(2 + 0.293) * 0.74, 4: 2 + 0.293 + 0.293 * 0.95, 5: -(2 - 0.293), 6: 2.0, 7: 0.0, 8: 0.0, 9: 0.0,
            10: (2 + 0.293) * 0.74 - (2 + 0.293 * 0.95) * 0.74}
    df = spark.createDataFrame([(i, t, "keep") for i, t in texts.items()], "doc_id long, text string, _w string")
    got = {r.doc_id: r for r in TX.sentiment_scores(df, "text", lexicon=lexicon, modifiers=TX.modifier_table(spark)).collect()}
    assert set(got) == set(texts) and got[1]["_w"] == "keep"
    for i, s in want.items():
        assert abs(got[i].compound - compound(s)) < 1e-9, i
    assert got[2].neg > 0 and got[2].pos == 0 and got[7].neu == 1.0 and abs(got[3].neg + got[3].neu - 1) < 1e-9


def test_large_lexicon_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(TX, "BROADCAST_WORDS", 0)
    df = spark.createDataFrame([(1, "not good bad"), (2, "good")], "doc_id long, text string")
    lexicon = TX.lexicon_table(spark).toDF("word", "valence", "subjectivity")
    rows = {r.doc_id: r.compound for r in TX.sentiment_scores(df, "text", lexicon=lexicon, modifiers=TX.modifier_table(spark)).collect()}
    assert rows[1] != rows[2] and abs(rows[2] - compound(1.9)) < 1e-9


def test_default_lexicon_as_a_table_gives_the_same(spark):
    df = spark.createDataFrame([(1, "a good and great day, no problem"), (2, None), (3, "x")], "doc_id long, text string")
    lexicon = TX.lexicon_table(spark).toDF("word", "valence", "subjectivity")
    assert sorted(TX.sentiment_scores(df, "text").collect()) == sorted(TX.sentiment_scores(df, "text", lexicon=lexicon).collect())
