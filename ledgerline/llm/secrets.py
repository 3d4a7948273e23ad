"""Secret scan with SQL functions only: patterns plus a randomness battery.

Base kinds are patterns (``assign``, ``access``, ``hex``).  The method adds
kind ``random``: runs of 20 or more key characters that overlap no base span
and whose characters look drawn at random.  For the alphabet inferred from a
run (decimal, hex, base32, ..., base64) three statistics are taken, each about
standard normal for random characters:

* chi-squared uniformity over the alphabet (Wilson-Hilferty normal score),
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* lag-one serial correlation of the alphabet positions.

Their squares add up to a score, small for random and large for written text.
How small written text gets at a length is measured on the corpus itself: runs
of letters only (16 or more) are the reference, all of them, by length class;
a class also takes the shorter ones, whose scores are smaller.  A class with
fewer than ``LEAST_RUNS`` of them in the whole corpus takes the words of a fixed
list as well, so that a corpus with few long words has a reference too.
Within each length class the Benjamini-Hochberg rule at rate ``fdr`` is applied to the
empirical p-values, from a histogram of scores with a fixed number of cells.

Runs of letters only are the reference and never reported: a key without a
digit or sign cannot be told from a long word by these tests.

Defined cases: a null or empty text has no spans; repeated rows repeat; an
empty table gives an empty result; extra columns pass through, own columns are
under the struct ``_secrets``.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the contract
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""((?i){KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 or more characters in all
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
MIN_RANDOM = 20
STRATA = (24, 32, 48, 1 << 30)  # lengths below each bound form a class
CELLS, CELL = 46, 0.25  # scores up to 11.3: the chi-squared 1 % point for three squares
LEAST_RUNS = 400
# fixed values: parts of long words; every pair and triple of them is a word of the reference
PARTS = ("international", "counter", "electro", "magnetic", "responsibility", "micro", "biological", "incomprehen", "sibility", "mis",
         "interpretation", "pharma", "ceutical", "thermo", "dynamics", "over", "simplification", "neuro", "transmission", "auto",
         "correlation", "hydro", "mechanical", "characteristic")
_DIGITS, _LOWER, _UPPER =_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (("^[0-9]+$", _DIGITS), ("^[0-9a-f]+$", _DIGITS + _LOWER[:6]), ("^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
             ("^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]), ("^[a-z]+$", _LOWER), ("^[0-9a-z]+$", _DIGITS + _LOWER),
             ("^[0-9A-Z]+$", _DIGITS + _UPPER), ("^[A-Za-z]+$", _UPPER + _LOWER),
             ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS), ("", _UPPER + _LOWER + _DIGITS + "+/"))
_SPAN = "array<struct<s:int,o:int,e:int,t:string>>"


def _spans(text: Column, pattern: str, order: int, gate: Column, keep=None) -> Column:
    """(start, kind order, end, matched text) of the leftmost non-overlapping
    matches; offsets come from the lengths of the gaps between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(acc, x):
        start = acc["pos"] + x["g"]
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("s"), F.lit(order).alias("o"), end.alias("e"), x["m"].alias("t")))
        out = F.concat(acc["out"], span)
        return F.struct(end.alias("pos"), (out if keep is None else F.when(keep(x["m"]), out).otherwise(acc["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))
    return F.when(gate, F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _score(token: Column) -> Column:
    """Sum of the squared normal scores of the three tests; small: random."""
    plain = F.translate(token, "-_", "+/")
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(plain.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def battery(x):
        # x: k alphabet size, i alphabet positions
        k, pos = x["k"], x["i"]
        n = F.size(pos).cast("double")
        squares = F.aggregate(F.array_distinct(pos), F.lit(0.0),
                              lambda a, c: a + F.pow(F.size(F.filter(pos, lambda y: y == c)).cast("double"), F.lit(2.0)))
        df = k - 1.0
        chi = F.greatest(k / n * squares - n, F.lit(0.0))
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        pairs = F.zip_with(F.slice(pos, F.lit(1), F.size(pos) - 1), F.slice(pos, F.lit(2), F.size(pos) - 1),
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(pos, lambda y: y > k / 2)).cast("double")
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] > k / 2) != (p["b"] > k / 2)))
        mu = 2 * high * (n - high) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        z_runs = F.when(var > 0, (runs - mu) / F.sqrt(var)).otherwise(F.sqrt(n))
        mean = F.aggregate(pos, F.lit(0.0), lambda a, y: a + y) / n
        power = F.aggregate(pos, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        z_lag = F.when(power > 0, lagged / power * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2.0)) + F.pow(z_runs, F.lit(2.0)) + F.pow(z_lag, F.lit(2.0))

    # one-element arrays bind a value to a name inside an expression
    bound = F.transform(F.array(F.struct(plain.alias("t"), alphabet.alias("abc"))), lambda v: F.struct(
        F.length(v["abc"]).cast("double").alias("k"),
        F.transform(F.split(v["t"], ""), lambda c: F.instr(v["abc"], c).cast("double")).alias("i")))
    return F.element_at(F.transform(bound, battery), 1)


def _stratum(length: Column) -> Column:
    out = F.lit(len(STRATA) - 1)
    for i, bound in reversed(list(enumerate(STRATA[:-1]))):
        out = F.when(length < bound, F.lit(i)).otherwise(out)
    return out


def scan(docs: DataFrame, text_col: str = "text", prefix: str = "_ll6_") -> DataFrame:
    """``docs`` with the base spans and the scored candidates of every text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base, cand = prefix + "base", prefix + "cand"
    group2 = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    out = docs.withColumn(base, F.concat(
        _spans(text, ASSIGN, 0, text.rlike(rf"""(?i:{KEYWORDS})["']?\x20*[:=]"""), group2),
        _spans(text, ACCESS, 1, text.contains("AKIA")),
        _spans(text, HEX, 2, text.rlike(HEX))))
    runs = _spans(text, CANDIDATE, 3, text.rlike(CANDIDATE))
    out = out.withColumn(cand, F.filter(runs, lambda c: ~F.exists(
        F.col(base), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    return out.withColumn(cand, F.transform(F.col(cand), lambda c: F.struct(
        c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e"),
        _stratum(c["e"] - c["s"]).alias("stratum"),
        F.when(c["t"].rlike("^[A-Za-z]+$"), 0).when(c["e"] - c["s"] >= MIN_RANDOM, 1).otherwise(2).alias("role"),
        F.least(F.floor(_score(c["t"]) / CELL), F.lit(CELLS)).cast("int").alias("cell"))))


def fixed_runs(spark) -> DataFrame:
    """``stratum``, ``role`` 3, ``cell``, ``n`` of the words of the fixed list."""
    part = spark.range(len(PARTS)).select(F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.col("id").cast("int") + 1).alias("p"))
    two = part.join(part.withColumnRenamed("p", "q"), F.col("p") != F.col("q")).select(F.concat("p", "q").alias("t"), "q")
    three = two.join(part, F.col("p") != F.col("q")).select(F.concat("t", "p").alias("t"))
    words = two.select("t").unionByName(three).where(F.length("t") >= MIN_RANDOM)  # some thousand words
    return words.select(_stratum(F.length("t")).alias("stratum"), F.lit(3).alias("role"),
                        F.least(F.floor(_score(F.col("t")) / CELL), F.lit(CELLS)).cast("int").alias("cell")) \
                .groupBy("stratum", "role", "cell").agg(F.count(F.lit(1)).alias("n"))


def cut_offs(scanned: DataFrame, fdr: float = 0.05, prefix: str = "_ll6_") -> dict[int, int]:
    """Length class -> last histogram cell that the Benjamini-Hochberg rule
    accepts.  Over all candidates; at most ``len(STRATA)`` rows are fetched."""
    spark = scanned.sparkSession
    hist = (scanned.select(F.explode(prefix + "cand").alias("c")).groupBy("c.stratum", "c.role", "c.cell")
                   .agg(F.count(F.lit(1)).alias("n")).unionByName(fixed_runs(spark)))
    grid = spark.range(len(STRATA) * (CELLS + 1)).select(
        (F.col("id") / (CELLS + 1)).cast("int").alias("stratum"), (F.col("id") % (CELLS + 1)).cast("int").alias("cell"))
    both = hist.groupBy("stratum", "cell").agg(
        *[F.sum(F.when(F.col("role") == r, F.col("n"))).alias(c) for r, c in ((0, "ref"), (1, "hyp"), (3, "fixed"))])
    full = grid.join(both, ["stratum", "cell"], "left").fillna(0, ["ref", "hyp", "fixed"])
    # bounded windows: the grid has len(STRATA) * (CELLS + 1) rows at any input size
    up = Window.partitionBy("cell").orderBy("stratum")
    within = Window.partitionBy("stratum").orderBy("cell")
    whole = Window.partitionBy("stratum")
    rule = (full.withColumn("ref", F.sum("ref").over(up)).withColumn("fixed", F.sum("fixed").over(up))
                .withColumn("ref", F.col("ref") + F.when(F.sum("ref").over(whole) < LEAST_RUNS, F.col("fixed")).otherwise(0))
                .withColumn("p", (1 + F.sum("ref").over(within)) / (1 + F.sum("ref").over(whole)))
                .withColumn("found", F.sum("hyp").over(within)).withColumn("all", F.sum("hyp").over(whole))
                .where((F.col("cell") < CELLS) & (F.col("found") > 0) & (F.col("p") * F.col("all") <= fdr * F.col("found")))
                .groupBy("stratum").agg(F.max("cell").alias("cell")))
    return {r["stratum"]: r["cell"] for r in rule.collect()}


def judge(scanned: DataFrame, cuts: dict[int, int], prefix: str = "_ll6_") -> DataFrame:
    """Adds ``_secrets``: base spans and all spans, as arrays of (s, o, e)
    sorted by start, then kind as in ``KINDS``."""
    accept = F.lit(False)
    slim = lambda c: F.struct(c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e"))
    base = F.array_sort(F.transform(F.col(prefix + "base"), slim))

    def random(c):
        ok = accept
        for stratum, cell in cuts.items():
            ok = ok | ((c["stratum"] == stratum) & (c["cell"] <= cell))
        return (c["role"] == 1) & ok

    extra = F.transform(F.filter(F.col(prefix + "cand"), random), slim)
    return (scanned.withColumn("_secrets", F.struct(base.alias("base"), F.array_sort(F.concat(base, extra)).alias("all")))
                   .drop(prefix + "base", prefix + "cand"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every covered stretch replaced by ``mark``."""
    def step(acc, x):
        gap = F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"])
        fresh = F.struct(x["e"].alias("pos"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), acc["out"].alias("out"))
        return F.when((x["s"] >= acc["pos"]), fresh).otherwise(longer)

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
