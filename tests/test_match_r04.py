"""Vectors of asked terms have the lengths of whole documents; candidates are tested before their skills are looked for."""
import math

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import text as TX
from ledgerline.session import reliable_checkpoint


def test_asked_terms_over_whole_lengths(spark):
    rows = [("q", 1, "a", 2), ("q", 1, "b", 1), ("d", 1, "a", 1), ("d", 1, "c", 4), ("d", None, "b", 3), ("d", None, "d", 1), ("d", 7, "c", 1)]
    terms = reliable_checkpoint(spark.createDataFrame(rows, "_src string, _id long, term string, tf long"))
    key = lambda r: (r._src, r._id, r.term)
    every = {key(r): (r.w, r._df) for r in TX.tfidf_vectors(terms, ["_src", "_id"]).collect()}
    asked = {key(r): (r.w, r._df) for r in TX.tfidf_vectors(terms, ["_src", "_id"], asked=F.col("_src") == "q").collect()}
    assert len(every) == 7 and asked == {k: v for k, v in every.items() if k[2] in "ab"}
    idf = lambda df: math.log(5 / (1 + df)) + 1  # noqa: E731  (four documents)
    assert asked["d", 1, "a"] == (pytest.approx(idf(2) / math.hypot(idf(2), 4 * idf(2))), 2)
    assert asked["d", None, "b"] == (pytest.approx(3 * idf(2) / math.hypot(3 * idf(2), idf(1))), 2)


def test_checks_need_no_skills(spark):
    rows = [(1, 2.0, ["MSc in Physics"], 3.0, None), (2, 4.0, [], 3.0, "Bachelor"), (3, None, ["bachelor of Arts"], None, "Bachelor"), (4, None, [], None, None),
            (5, None, [], 1.0, None)]
    df = spark.createDataFrame(rows, "k int, experience_years double, education array<string>, min_experience double, education_level string")
    exp, edu = TX.requirement_checks()
    assert {r.k: (r.e, r.d) for r in df.select("k", exp.alias("e"), edu.alias("d")).collect()} == {
        1: (False, True), 2: (True, False), 3: (True, True), 4: (True, True), 5: (False, True)}
