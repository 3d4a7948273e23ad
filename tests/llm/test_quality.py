"""Quality rules against a plain count."""
import random
import re

from ledgerline.llm import quality
from ledgerline.llm.common import prepare


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def repeat_brute(words):
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 5))
    return len(hit)


def norm(line):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return " ".join(words_of(t))


def brute(rows, min_docs, share, max_removed=0.7):
    hosts = {}
    for _, h, t in rows:
        hosts.setdefault(h or "", set()).add(t or "")
    often = {h: {ln for ln in {norm(x) for t in ts for x in t.split("\n")} if ln and
                 (n := sum(ln in {norm(x) for x in t.split("\n")} for t in ts)) > min_docs and n > share * len(ts)}
             for h, ts in hosts.items()}
    out = []
    for i, h, t in rows:
        t = t or ""
        words, lines = words_of(t), t.split("\n")
        filled = [x for x in lines if words_of(x)]
        rep = repeat_brute(words)
        removed = [x for x in lines if norm(x) in often[h or ""]]
        gone = sum(len(words_of(x)) for x in removed)
        failed = len(words) < 10 or 100 * rep > 20 * len(words)
        depleted = bool(removed) and (len(words) - gone < 10 or gone > max_removed * len(words))
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(filled) - len(set(filled)), rep,
                    len(removed), gone, failed, not failed and not depleted, "\n".join(x for x in lines if norm(x) not in often[h or ""])))
    return out


def test_matches_brute_force(spark):
    prepare(spark)
    rng = random.Random(21)
    vocab = ["the", "Of", "é", "#a", "x|y", "ß", "t u", "*", "no break"] + [f"w{i}" for i in range(40)]
    line = lambda n: rng.choice([" ", "  ", "\t", "\r "]).join(rng.choice(vocab) for _ in range(n))
    common = [line(6) for _ in range(4)]
    rows = []
    for i in range(160):
        ls = [line(rng.randint(0, 9)) for _ in range(rng.randint(0, 6))]
        ls += [rng.choice(common).upper() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.2 and ls:
            ls += [ls[0]] * 3
        rng.shuffle(ls)
        rows.append((i, rng.choice(["h1", "h1", "h2", "h3", None, ""]), "\n".join(ls)))
    rows += [(i + 500, "h2", rows[0][2]) for i in range(40)]  # copies do not make lines frequent
    rows += [rows[1], rows[1], (900, "h1", None), (901, "h1", ""), (902, "h1", " \n\t\n "), (903, "h2", "a b c d e " * 9000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, kept string")
    got = quality.line_frequency_rules(df, min_docs=3, max_share=0.1, with_text=True).collect()
    q = [(r.doc_id, *[r._quality[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines",
                                              "n_removed_words", "base_failed", "kept", "text")]) for r in got]
    small = [r for r in rows if r[0] != 903]
    assert sorted(x for x in map(str, q) if not x.startswith("(903,")) == sorted(map(str, brute(rows[:-1], 3, 0.1)))
    assert len(q) == len(small) + 1
    big = next(x for x in q if x[0] == 903)
    assert big[1] == 45000 and big[5] == 45000 and big[8] is True
    assert any(x[6] for x in q)


def test_repeat_words_of_long_texts():
    rng = random.Random(22)
    for vocab in (3, 30, 9000):
        words = [f"v{rng.randrange(vocab)}".encode() for _ in range(1500)] + [b"a", b"b", b"c", b"d", b"e"] * 2
        assert quality.repeat_words(words) == repeat_brute(words)


def test_empty(spark):
    prepare(spark)
    assert quality.line_frequency_rules(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
