"""Out-of-fold prices and encodings of text files."""
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import pricing
from ledgerline.session import scratch_dir
from ledgerline.sources import files


def test_no_product_sees_itself(spark):
    rows = [(i, "a" if i < 12 else "b", float(i)) for i in range(20)] + [(99, "alone", 5.0)]
    df = spark.createDataFrame(rows, "id long, cat string, price double")
    got = {r.id: r.ml_price for r in pricing.out_of_fold(df, F.col("id"), pricing.group_mean_model("price", "cat")).collect()}
    for i, cat, _ in rows:
        others = [p for j, c, p in rows if c == cat and j % 5 != i % 5]
        assert got[i] == (pytest.approx(sum(others) / len(others)) if others else None)


def test_forest_prices_are_blended_and_bounded(spark):
    rows = [(i, "ab"[i % 2], 10.0 + i % 7, 20.0 + 3 * (i % 7) + (i % 2) * 10) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, cat string, cost double, current_price double").withColumn("competitor_price", F.lit(None).cast("double")) \
              .withColumn("elasticity", F.lit(-1.0))
    x = pricing.out_of_fold(df, F.col("id"), pricing.forest_model("current_price", ["cost"], ["cat"], "id", trees=20))
    p = {r.id: r for r in pricing.apply_strategies(x, ["ml_optimized"], ml_price=F.col("ml_price")).collect()}
    assert len(p) == 80
    for i, r in p.items():
        assert abs(r.ml_price - r.current_price) < 3.5  # the price follows from cost and category
        assert r.new_price == pytest.approx(max(0.7 * r.ml_price + 0.3 * r.current_price, 1.05 * r.cost), abs=0.0051)


@pytest.mark.parametrize("text,encoding,want", [
    ("naïve;12\nplain;3\n", "utf-8", "UTF-8"), ("naïve;12\nplain;3\n", "latin-1", "ISO-8859-1"), ("5 €;12\n“x”;3\n", "cp1252", "CP1252"),
    ("plain;1\n", "ascii", "UTF-8"), ("é\x81;1\n", "latin-1", "ISO-8859-1")])
def test_encoding_is_found(spark, text, encoding, want):
    folder = scratch_dir("enc-")
    with open(f"{folder}/a.csv", "wb") as f:
        f.write(("näme;wert\n" if encoding != "ascii" else "name;wert\n").encode(encoding) + text.encode(encoding))
    assert files.sniff_encoding(spark, folder) == want
    df = files.scan_csv_sniff(spark, folder)
    assert df.columns == ["näme" if encoding != "ascii" else "name", "wert"]
    assert [r[0] for r in df.collect()] == [line.split(";")[0] for line in text.strip("\n").split("\n")]
