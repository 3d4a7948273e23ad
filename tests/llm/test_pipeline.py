"""Every stage of the corpus pipeline on planted rows, against the operators' brute-force versions."""
import random

import pytest

import corpus_pipeline as cp
from ledgerline.llm import decontaminate
from ledgerline.session import scratch_dir

from .test_quality import brute as quality_brute
from .test_secrets import brute as secret_brute
from .test_simhash import brute_components, brute_print

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(30)
    vocab = ["the", "of", "and"] * 5 + [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows = [(i, "\n".join(text(rng.randint(8, 20)) for _ in range(rng.randint(3, 8))), "en", f"src{i % 3}") for i in range(120)]
    clean = {r[0] for r in rows}
    rows += [(200 + i, rows[i][1], "en", "src1") for i in range(20)]  # exact copies
    near = {}
    for i in range(20, 30):  # one word of a long text differs
        base = (rows[i][1] + " " + rows[i + 1][1] + " " + rows[i + 2][1] + " " + text(300)).split(" ")
        rows.append((300 + 2 * i, " ".join(base), "en", "src0"))
        rows.append((301 + 2 * i, " ".join(base[:-1] + ["edited"]), "en", "src2"))
        near[301 + 2 * i] = 300 + 2 * i
    rows += [(400 + i, text(40) + " " + items[i][1].upper() + ". " + text(40), "en", "src0") for i in range(5)]  # leaks
    rows += [(500, text(60) + " password=Hunter2secret " + text(10), "de", "src2"), (501, "too short", "en", "src0"),
             (502, "a b c d e " * 30, "en", "src1"), (503, None, None, None), (504, "", "fr", "src1")]
    rows = [(*r, len(r[1] or ""), "x") for r in rows]
    folder = scratch_dir()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, clean, near


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, corpus):
    folder, rows, items, clean, near = corpus
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    docs, results = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = f"{scratch_dir()}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        results[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns
        given = rows_of(before)
        source = {r.doc_id: r.source for r in before.select("doc_id", "source").collect()}
        if name == "quality_rules":
            want = sorted((b[0], b[-1]) for b in quality_brute([(i, source[i], t) for i, t in given], 10, 0.10) if b[-2])
            assert {501, 502, 503, 504}.isdisjoint(i for i, _ in want)
        elif name == "simhash_near_dedup":
            prints = [(i, brute_print(t)) for i, t in given]
            want = sorted(g for g, c in zip(given, brute_components(prints)) if g[0] == c)
            assert not {200 + i for i in range(20)} & {i for i, _ in want}
        elif name == "decontamination":
            held = [decontaminate.WORDS.findall(t.lower()) for _, t in items]
            found = {i for i, t in given for w in held if " ".join(w) in " ".join(decontaminate.WORDS.findall(t.lower()))}
            want = [g for g in given if g[0] not in found]
            assert found == {400 + i for i in range(5)}
        elif name == "secret_scan":
            want = []
            for i, t in given:
                for span in reversed([s for s in secret_brute(t).split(",") if s]):
                    _, a, b = span.split(":")
                    t = t[:int(a)] + "[SECRET]" + t[int(b):]
                want.append((i, t))
        else:
            want = given
            assert set(docs.columns) > {"n_tokens", "ids_sha256", "decoded_sha256"}
        assert rows_of(docs) == want
        assert all(r.n_chars == len(r.text) for r in docs.select("text", "n_chars").collect())
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(clean & kept) >= 0.97 * len(clean)
    assert len([b for b in near if b not in kept]) >= 6


def test_run_and_repeated_rows(spark, corpus):
    folder, rows, items, _, _ = corpus
    again = scratch_dir()
    df = spark.createDataFrame(rows + rows[:10] + [(None, rows[0][1], "en", "src0", 5, "x")], COLUMNS)
    df.write.parquet(f"{again}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{again}/benchmark.parquet")
    one, two = cp.run(spark, folder), cp.run(spark, again)
    assert rows_of(one.select("doc_id", "text")) == rows_of(two.select("doc_id", "text"))
    empty = scratch_dir()
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).count() == 0
    assert cp.ORACLE_SQL is None
