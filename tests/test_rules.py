"""Rule tables and regex extractors on hand fixtures."""
import math

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import text as T
from ledgerline.operators import pricing, supply
from ledgerline.operators import text as TX


def test_price_strategies_fixture(spark):
    rows = [("P1", 10.0, 20.0, 22.0, -2.0), ("P2", 50.0, 40.0, None, -0.2), ("P3", 5.0, 100.0, 90.0, -1.2)]
    df = spark.createDataFrame(rows, "product_id string, cost double, current_price double, competitor_price double, elasticity double")
    out = {(r.product_id, r.strategy): r.new_price for r in pricing.apply_strategies(df).collect()}
    assert out[("P1", "cost_plus")] == 13.0
    assert out[("P1", "price_skimming")] == 24.0
    assert out[("P1", "penetration")] == 17.0
    assert out[("P1", "competitor_discount")] == 20.9
    # below-cost price is floored at 1.05 × cost
    assert out[("P2", "penetration")] == 55.0
    # no competitor: competitor prices unknown, dynamic uses the 0.95 clamp
    assert out[("P2", "competitor_match")] is None
    assert out[("P2", "dynamic")] == round(max(40 * 1.02 * 0.95, 55.0, 52.5), 2)
    # elastic (< -1, ≥ -1.5): 0.98; ratio clamp 100/90 → 1.05
    assert out[("P3", "dynamic")] == round(100 * 0.98 * 1.05, 2)


def test_delay_rules_fixture(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1.0, 1, "storm", "congested", "truck"),
            (2, 0.0, 0.0, 0.0, 0.0, 3, "normal", "normal", "van")]
    df = spark.createDataFrame(rows, "id int, o_lat double, o_lon double, d_lat double, d_lon double, priority int, weather string, traffic string, vehicle_type string")
    r = {x.id: x for x in supply.delay_prediction(df).collect()}
    km = 6371 * math.radians(1.0)
    assert abs(r[1].distance_km - km) < 1e-6
    assert abs(r[1].delay_hours - (km / 60 * (2.5 * 2.0 * 1.2) - km / 60)) < 1e-9
    assert abs(r[1].confidence - 0.65) < 1e-12
    assert "check the forecast again before departure" in r[1].suggested_actions
    assert "urgent order (priority 1 or 2)" in r[1].risk_factors
    assert r[2].delay_hours == 0.0 and r[2].risk_factors == [] and r[2].suggested_actions == []


def test_normal_cdf_accuracy(spark):
    zs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(S.normal_cdf("z").alias("p")).collect()
    for z, r in zip(zs, got):
        assert abs(r.p - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7


def test_text_extractors(spark):
    texts = ["I have twelve years of experience with C++ and C#, plus .NET. Mail me: jane.doe@example.com or call (555) 123-4567!",
             "Worked for 3.5 years; 7 years in the industry. Bachelor of Science. Are you afraid? Really?!",
             ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    r = df.select("id", T.experience_years(F.col("text")).alias("years"), T.extract_skills(F.col("text")).alias("skills"),
                  T.email(F.col("text")).alias("email"), T.phone(F.col("text")).alias("phone")).collect()
    assert r[0].years == 12.0 and r[1].years == 7.0 and r[2].years is None
    assert set(r[0].skills) >= {"C++", "C#", ".NET"}
    assert r[0].email == "jane.doe@example.com" and r[0].phone is not None
    emo = sorted(TX.sentiment_analyze(df, "text", id_col="id").select("id", "surprise", "fear", "neu", "compound").collect())
    assert abs(emo[0].surprise - 0.2) < 1e-12          # one '!'
    assert abs(emo[1].surprise - 0.2) < 1e-12          # two '?' overwrite the '!' rule: 2 × 0.1
    assert abs(emo[1].fear - 0.3) < 1e-12
    assert emo[2].neu == 1.0 and emo[2].compound == 0.0


def test_date_rules(spark):
    df = spark.createDataFrame(pd.DataFrame({"d": pd.to_datetime(["2024-07-04", "2024-07-06", "2024-07-08", "2024-02-29"])}))
    r = df.select(S.is_holiday("d").alias("h"), S.season_weather("d").alias("w"),
                  *[c.alias(k) for k, c in S.date_features("d").items()]).collect()
    assert [x.h for x in r] == [True, True, False, False]
    assert [x.w for x in r] == [1, 1, 1, 4]
    assert r[0].day_of_week == 3 and r[3].is_month_end == 1


def test_aspect_context_window_matches_brute_force(spark, monkeypatch):
    """The bounded (doc, position ± 5) context join equals a direct scan."""
    import re
    from ledgerline.plans import q_extra, q_text
    texts = ["The price was great but the service was terrible and slow, bad staff.",
             "Good quality product. Delivery time: awful, horrible delay; price fine.",
             "nothing relevant here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(q_text, "docs", lambda spark_, d: df)
    got = {(r.doc_id, r.aspect): (r.mentions, r.sentiment_words, r.valence)
           for r in q_extra.q_aspect_sentiment(spark, None).collect()}
    exp = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W]+", t.lower())
        for p, tok in enumerate(w):
            if tok in q_extra.ASPECT_TERMS:
                m, sw, v = exp.get((i, tok), (set(), 0, 0.0))
                m.add(p)
                for o in range(-q_extra.WINDOW, q_extra.WINDOW + 1):
                    if o and 0 <= p + o < len(w) and w[p + o] in TX.LEXICON:
                        sw += 1
                        v += TX.LEXICON[w[p + o]][0]
                exp[(i, tok)] = (m, sw, v)
    assert set(got) == set(exp)
    for k, (m, sw, v) in exp.items():
        assert got[k][0] == len(m) and got[k][1] == sw and abs(got[k][2] - round(v, 6)) < 1e-9
