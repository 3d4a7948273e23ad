"""The best of several readings of a table, its records and their source."""
from ledgerline.operators import layout
from ledgerline.plans import q_extra

KIND = "doc string, row_id int, cells array<string>"


def test_candidate_with_most_cells_wins(spark):
    a = [("t", 0, ["Name", "Age"]), ("t", 1, ["Ann", "30"]), ("t", 2, ["Bob", "31", "x"]),  # 7 cells, 3 rows
         ("one", 0, ["a"] * 9), ("tie", 0, ["k"]), ("tie", 2, ["v"]), ("none", 0, ["z"]), (None, 0, ["n"]), (None, 1, ["m"])]
    b = [("t", 0, ["Name Age"]), ("t", 1, ["Ann 30"]), ("one", 0, [" ", ""]), ("one", 3, ["h ", "i"]), ("one", 4, ["1", " 2 ", " "]),
         ("tie", 0, ["K"]), ("tie", 1, ["V"]), (None, 0, ["o", "p"]), (None, 5, ["q"])]
    rows = layout.best_tables([("a", spark.createDataFrame(a, KIND)), ("b", spark.createDataFrame(b, KIND))], "doc")
    got = sorted(((r.doc or "", r.method, r.n_rows, r.n_cells, r.row_id, r.rec) for r in rows.withColumn("rec", layout.record("header", "cells")).collect()))
    assert got == [("", "b", 2, 3, 5, ["o: q"]), ("one", "b", 2, 4, 4, ["h: 1", "i: 2"]),
                   ("t", "a", 3, 7, 1, ["Name: Ann", "Age: 30"]), ("t", "a", 3, 7, 2, ["Name: Bob", "Age: 31", "Column 3: x"]),
                   ("tie", "a", 2, 2, 2, ["k: v"])]


def test_query_gives_records_with_source(spark, tmp_path):
    texts = [(1, "Name  Age\n\nAnn  30\nBob   31  x"), (2, "Full name\nAnn Lee"), (3, "one line only"), (4, ""), (5, None), (6, "one\ntwo")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.source, r.method, r.n_rows, r.n_cells, r.record.split("\x1f")) for r in q_extra.q_table_from_words(spark, str(tmp_path)).collect())
    assert got == [(1, "document 1", "lines", 3, 7, ["Name: Ann", "Age: 30"]), (1, "document 1", "lines", 3, 7, ["Name: Bob", "Age: 31", "Column 3: x"]),
                   (2, "document 2", "boxes", 2, 4, ["Full: Ann", "name: Lee"]), (6, "document 6", "lines", 2, 2, ["one: two"])]
