"""Text analytics over whole documents: lexicon sentiment, emotions, CV
profiles, TF-IDF similarity and top-n matching.

Sentiment is a narrow projection: every word of the full text is looked up
in a literal lexicon map and folded with ``aggregate`` inside the row, so no
explode / shuffle happens.  TF-IDF needs document frequencies, so it is a
real distributed job: terms exploded, counted per document, joined with
the per-term document frequency, then job × document scores of blocks of
both, each block in one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.functions import text as T
from ledgerline.functions.scalars import sentiment_confidence, sentiment_label
from ledgerline.operators import stats
from ledgerline.session import reliable_checkpoint, shuffle_partitions

# Fixed values (our own small lexicon): word → (valence on −4..4, subjectivity 0..1).
LEXICON = {
    "good": (1.9, 0.6), "great": (3.1, 0.75), "excellent": (3.2, 1.0), "happy": (2.7, 1.0),
    "love": (3.2, 0.6), "like": (1.5, 0.5), "best": (3.2, 0.3), "nice": (1.8, 1.0),
    "wonderful": (2.7, 1.0), "amazing": (2.8, 0.9), "fantastic": (2.6, 0.9), "positive": (2.3, 0.55),
    "fine": (0.8, 0.5), "glad": (2.0, 1.0), "success": (2.7, 0.6), "win": (2.8, 0.5),
    "bad": (-2.5, 0.67), "terrible": (-2.5, 1.0), "awful": (-2.0, 1.0), "hate": (-2.7, 0.9),
    "worst": (-3.1, 1.0), "poor": (-2.1, 0.6), "sad": (-2.1, 1.0), "angry": (-2.3, 1.0),
    "horrible": (-2.5, 1.0), "negative": (-2.7, 0.4), "wrong": (-2.1, 0.9), "problem": (-1.7, 0.5),
    "error": (-1.4, 0.3), "fail": (-2.3, 0.5), "afraid": (-1.9, 0.9), "fear": (-2.2, 0.8),
    "worried": (-1.2, 0.9), "scared": (-2.2, 0.9), "anxious": (-1.0, 1.0),
    "bon": (1.9, 0.6), "bien": (1.5, 0.5), "mauvais": (-2.5, 0.7), "gut": (1.9, 0.6),
    "schlecht": (-2.5, 0.7), "bueno": (1.9, 0.6), "malo": (-2.5, 0.7),
}
COMPOUND_ALPHA = 15.0


def _lex_map(idx: int):
    return F.create_map(*[v for k, val in LEXICON.items() for v in (F.lit(k), F.lit(float(val[idx])))])


def sentiment_scores_rowwise(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds neg, neu, pos, compound (valence sum s → s/√(s²+15)),
    polarity (mean valence/4 over lexicon hits, clipped to ±1) and
    subjectivity (mean over hits); a text without words scores
    (0, 1, 0, 0).  One ``aggregate`` pass over the words of the whole text
    with a struct accumulator."""
    w = T.words(F.lower(F.col(text_col)))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ps"), F.lit(0.0).alias("ns"), F.lit(0).alias("nh"), F.lit(0.0).alias("subj"))
    val, sub = _lex_map(0), _lex_map(1)

    def step(acc, x):
        return F.struct(
            (acc["s"] + x["v"]).alias("s"),
            (acc["ps"] + F.when(x["v"] > 0, x["v"] + 1).otherwise(0.0)).alias("ps"),
            (acc["ns"] + F.when(x["v"] < 0, x["v"] - 1).otherwise(0.0)).alias("ns"),
            (acc["nh"] + 1).alias("nh"), (acc["subj"] + x["j"]).alias("subj"))

    # most words are no hits: a hashed test drops them before the maps are searched
    hits = F.transform(F.filter("_ll_words", lambda x: x.isin(*LEXICON)), lambda x: F.struct(val[x].alias("v"), sub[x].alias("j")))
    x = docs.withColumn("_ll_words", w).withColumn("_a", F.aggregate(hits, zero, step)) \
            .withColumn("_a", F.col("_a").withField("neu", (F.size("_ll_words") - F.col("_a")["nh"]).cast("double")))
    s, ps, ns, neu, nh = (F.col("_a")[k] for k in ("s", "ps", "ns", "neu", "nh"))
    tot = ps - ns + neu
    empty = tot == 0
    return x.select(
        *docs.columns,
        F.when(empty, 0.0).otherwise(-ns / tot).alias("neg"),
        F.when(empty, 1.0).otherwise(neu / tot).alias("neu"),
        F.when(empty, 0.0).otherwise(ps / tot).alias("pos"),
        (s / F.sqrt(s * s + COMPOUND_ALPHA)).alias("compound"),
        F.when(nh == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s / 4.0 / nh))).alias("polarity"),
        F.when(nh == 0, 0.0).otherwise(F.col("_a")["subj"] / nh).alias("subjectivity"))


def lexicon_table(spark):
    """The lexicon as a small DataFrame (fixed size: a bounded broadcast)."""
    return spark.createDataFrame([(k, float(v), float(sj)) for k, (v, sj) in LEXICON.items()],
                                 "_w string, _v double, _sj double")


def _finish_scores(x: DataFrame, keep) -> DataFrame:
    s, ps, ns, neu, nh = (F.col(c) for c in ("_s", "_ps", "_ns", "_neu", "_nh"))
    tot = ps - ns + neu
    empty = tot == 0
    return x.select(
        *keep,
        F.when(empty, 0.0).otherwise(-ns / tot).alias("neg"),
        F.when(empty, 1.0).otherwise(neu / tot).alias("neu"),
        F.when(empty, 0.0).otherwise(ps / tot).alias("pos"),
        (s / F.sqrt(s * s + COMPOUND_ALPHA)).alias("compound"),
        F.when(nh == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s / 4.0 / nh))).alias("polarity"),
        F.when(nh == 0, 0.0).otherwise(F.col("_subj") / nh).alias("subjectivity"))


# How much a booster adds at one, two and three words' distance,
# what a negation among the three words before makes of a valence, and our own
# small list of both.
BOOST_BY_DISTANCE = (1.0, 0.95, 0.9)
NEGATED = -0.74
MODIFIERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "totally": 0.293, "most": 0.293, "too": 0.293,
             "slightly": -0.293, "somewhat": -0.293, "barely": -0.293, "hardly": -0.293, "almost": -0.293,
             "not": None, "no": None, "never": None, "without": None, "nor": None, "cannot": None, "pas": None, "nicht": None, "nunca": None}
BROADCAST_WORDS = 100_000


def modifier_table(spark):
    """Boosters (with what they add) and negations as a DataFrame."""
    return spark.createDataFrame([(k, v, v is None) for k, v in MODIFIERS.items()], "word string, boost double, negates boolean")


def _word_table(df: DataFrame, name: str, **columns) -> DataFrame:
    """One row per lower-case word; a broadcast hint only if its counted size allows one."""
    x = df.where(F.col("word").isNotNull()).groupBy(F.lower("word").alias(name)).agg(*[c.alias(n) for n, c in columns.items()])
    x = reliable_checkpoint(x)
    return F.broadcast(x) if x.count() <= BROADCAST_WORDS else x


def sentiment_scores(docs: DataFrame, text_col: str, id_col: str = "doc_id", lexicon: DataFrame | None = None,
                     modifiers: DataFrame | None = None) -> DataFrame:
    """Batch scorer: the words of every text are looked up in a lexicon
    (``word``, ``valence``, ``subjectivity``; our own small one by default) and
    summed per document with map-side partial aggregation.  The result is
    joined back to the document's other columns (not its text) on the unique id.

    With ``modifiers`` (``word``, ``boost``, ``negates``) a booster among the three
    words before a hit adds its boost to the size of the valence, less with
    distance, and a negation there turns the valence round.  A repeated word of
    either table counts with its mean valence or boost; null valences are no hits."""
    if lexicon is None:
        lex = F.broadcast(lexicon_table(docs.sparkSession))  # fixed size
    else:
        lex = _word_table(lexicon.where(F.col("valence").isNotNull()), "_w", _v=F.avg("valence"), _sj=F.coalesce(F.avg("subjectivity"), F.lit(0.0)))
    words = T.words(F.lower(F.col(text_col)))
    v = F.col("_v")
    sums = [F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(F.when(v > 0, v + 1)), F.lit(0.0)).alias("_ps"),
            F.coalesce(F.sum(F.when(v < 0, v - 1)), F.lit(0.0)).alias("_ns")]
    subj = F.coalesce(F.sum("_sj"), F.lit(0.0)).alias("_subj")
    if modifiers is None:
        x = docs.select(id_col, F.explode_outer(words).alias("_w")).join(lex, "_w", "left")
        agg = x.groupBy(id_col).agg(*sums, (F.count("_w") - F.count(v)).cast("double").alias("_neu"), F.count(v).alias("_nh"), subj)
    else:
        mod = _word_table(modifiers, "_m", _b=F.avg("boost"), _n=F.max(F.coalesce("negates", F.lit(False))))
        listed = docs.select(id_col, F.coalesce(words, F.array().cast("array<string>")).alias("_ws"))
        before = lambda k: F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.col("_ws"))
        rows = listed.select(id_col, F.explode_outer(F.arrays_zip(F.col("_ws").alias("w"), *[before(k).alias(f"p{k}") for k in (1, 2, 3)])).alias("_z"))
        hits = rows.select(id_col, F.col("_z.w").alias("_w"), *[F.col(f"_z.p{k}").alias(f"_p{k}") for k in (1, 2, 3)]).join(lex, "_w")
        boost, negated = F.lit(0.0), F.lit(False)
        for k, share in enumerate(BOOST_BY_DISTANCE, 1):
            hits = hits.join(mod.select(F.col("_m").alias(f"_p{k}"), F.col("_b").alias(f"_b{k}"), F.col("_n").alias(f"_n{k}")), f"_p{k}", "left")
            boost = boost + F.coalesce(F.col(f"_b{k}"), F.lit(0.0)) * share
            negated = negated | F.coalesce(F.col(f"_n{k}"), F.lit(False))
        value = F.col("_v") + F.signum("_v") * boost
        hits = hits.withColumn("_v", F.when(negated, value * NEGATED).otherwise(value))
        agg = hits.groupBy(id_col).agg(*sums, F.count(v).alias("_nh"), subj)
        agg = listed.select(id_col, F.size("_ws").alias("_nw")).join(agg, id_col, "left").fillna(0.0, ["_s", "_ps", "_ns", "_subj"]).fillna(0, ["_nh"])
        agg = agg.withColumn("_neu", (F.col("_nw") - F.col("_nh")).cast("double"))
    rest = docs.drop(text_col)
    scored = _finish_scores(agg, [id_col])
    return rest.join(scored, id_col) if len(rest.columns) > 1 else scored


def polarity_scores(polarity) -> dict:
    """Second scorer: polarity p → p>0: pos=(p+1)/2, neu=1−pos; p<0:
    neg=(1−p)/2, neu=1−neg; p=0: neu=1; compound=p."""
    p = F.col(polarity) if isinstance(polarity, str) else polarity
    pos = F.when(p > 0, (p + 1) / 2).otherwise(0.0)
    neg = F.when(p < 0, (1 - p) / 2).otherwise(0.0)
    neu = F.when(p > 0, 1 - (p + 1) / 2).when(p < 0, 1 - (1 - p) / 2).otherwise(1.0)
    return {"pos": pos, "neg": neg, "neu": neu, "compound": p}


def sentiment_analyze(docs: DataFrame, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """Label, confidence, language and emotions for a whole column; the
    ensemble blends the lexicon scorer (0.625) and the polarity scorer
    (0.375), the two-scorer weights.  Text-dependent signals are computed in
    a narrow projection and joined to the scores on the id without the text."""
    t = F.col(text_col)
    emo_raw = T.emotions(t, F.lit(0.0), F.lit(0.0))     # surprise and fear need only the text
    signals = docs.select(id_col, T.detect_language(t).alias("language"),
                          emo_raw["surprise"].alias("surprise"), emo_raw["fear"].alias("fear"))
    s = sentiment_scores(docs.select(id_col, text_col), text_col, id_col).join(signals, id_col)
    p = F.col("polarity")
    p2 = polarity_scores("polarity")
    ens = 0.625 * F.col("compound") + 0.375 * p2["compound"]
    s = s.withColumn("joy", F.when(p > 0.3, F.least(F.lit(1.0), p * 1.5)).otherwise(0.0)) \
         .withColumn("sadness", F.when(p < -0.3, F.least(F.lit(1.0), F.abs(p) * 1.2)).otherwise(0.0)) \
         .withColumn("anger", F.when(p < -0.3, F.least(F.lit(1.0), F.abs(p) * F.col("subjectivity"))).otherwise(0.0))
    extra = docs.drop(text_col)
    if len(extra.columns) > 1:
        s = extra.join(s, id_col)
    return s.withColumn("ensemble_compound", ens) \
            .withColumn("sentiment_label", sentiment_label("compound")) \
            .withColumn("confidence", sentiment_confidence("compound")) \
            .withColumn("mixed", (F.col("pos") > 0.2) & (F.col("neg") > 0.2)) \
            .withColumn("intensity", F.abs("compound"))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("texts"),
        F.coalesce(F.count_if(F.col("sentiment_label") == "positive") / n, F.lit(0.0)).alias("positive_share"),
        F.coalesce(F.count_if(F.col("sentiment_label") == "negative") / n, F.lit(0.0)).alias("negative_share"),
        F.coalesce(F.count_if(F.col("sentiment_label") == "neutral") / n, F.lit(0.0)).alias("neutral_share"),
        F.coalesce(F.avg("compound"), F.lit(0.0)).alias("avg_compound"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min_confidence"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"),
        F.coalesce(F.avg("joy"), F.lit(0.0)).alias("avg_joy"),
        F.coalesce(F.avg("surprise"), F.lit(0.0)).alias("avg_surprise"),
        F.coalesce(F.avg("fear"), F.lit(0.0)).alias("avg_fear"))


def sentiment_daily(scored: DataFrame, date_col: str) -> DataFrame:
    """Per date: mean compound and label counts as columns (one groupBy, no
    join of two aggregates)."""
    return scored.groupBy(F.to_date(date_col).alias("date")).agg(
        F.avg("compound").alias("avg_compound"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
        F.count_if(F.col("sentiment_label") == "neutral").alias("neutral"))


def cv_profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col(text_col)
    cleaned = T.clean_text(t)
    return docs.select(
        id_col,
        F.size(T.words(cleaned)).alias("word_count"),
        T.extract_skills(t).alias("skills"),
        T.experience_years(t).alias("experience_years"),
        T.email(t).alias("email"), T.phone(t).alias("phone"),
        F.size(T.education(t)).alias("education_mentions"))


def match_requirements(pairs: DataFrame, skills: str = "skills", experience: str = "experience_years",
                       education: str = "education", required: str = "required_skills",
                       min_experience: str = "min_experience", level: str = "education_level") -> DataFrame:
    """Adds, per (job, candidate) row: ``matched`` and ``missing`` required
    skills, ``experience_match`` (true without a minimum; an unknown experience
    fails one), ``education_match`` (true without a level; else some education
    mention contains it, whatever the case) and ``passes`` (both)."""
    exp, edu = requirement_checks(experience, education, min_experience, level)
    return pairs.withColumns({"matched": F.array_intersect(skills, required), "missing": F.array_except(required, skills),
                              "experience_match": exp, "education_match": edu, "passes": exp & edu})


def requirement_checks(experience: str = "experience_years", education: str = "education", min_experience: str = "min_experience",
                       level: str = "education_level"):
    """Whether a candidate meets the minimum experience and the education level of :func:`match_requirements`."""
    need = F.col(level)
    has = F.exists(F.col(education), lambda e: F.lower(e).contains(F.lower(need)))
    return (F.col(min_experience).isNull() | F.coalesce(F.col(experience) >= F.col(min_experience), F.lit(False)),
            need.isNull() | F.coalesce(has, F.lit(False)))


# ------------------------------------------------------------------ TF-IDF

# Bounds of a block of scores: queries, pairs, terms of its documents, matches held at a time.
QUERY_BLOCK = 1024
BLOCK_PAIRS = 1 << 20
BLOCK_TERMS = 1 << 19
MATCHES = 1 << 21


def doc_terms(docs: DataFrame, id_cols, text_col: str, bigrams: bool = True) -> DataFrame:
    """(ids…, term, tf): lower-case tokens of ≥ 2 word characters minus
    stop words, plus adjacent-token bigrams, counted per document.

    Row form, so everything runs in generated code (array lambdas run
    interpreted, element by element): tokens are ``posexplode``d, stop words
    dropped by a hashed ``isin``, the next kept token comes from ``lead``
    over the document's own tokens (a window bounded by the document), and
    the per-document counts reuse that partitioning (no second shuffle)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(T.WORD + "{2,}"), 0)
    # posexplode_outer: a plain explode makes the optimizer infer size(...) > 0
    # and push it below the projection, copying the tokenizer into a filter
    # partition the texts by document once: the explode, the lead window and
    # the per-document count then need no further exchange (texts are
    # shuffled instead of the larger token rows)
    x = docs.repartition(*ids).select(*ids, F.posexplode_outer(toks).alias("_pos", "_w")) \
            .filter(F.col("_w").isNotNull() & ~F.col("_w").isin(*T.STOP_WORDS))
    if bigrams:
        nxt = F.lead("_w").over(Window.partitionBy(*ids).orderBy("_pos"))
        x = x.withColumn("_bi", F.when(nxt.isNotNull(), F.concat(F.col("_w"), F.lit(" "), nxt)))
        x = x.select(*ids, F.explode(F.array("_w", "_bi")).alias("term")).filter(F.col("term").isNotNull())
    else:
        x = x.select(*ids, F.col("_w").alias("term"))
    return x.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vectors(terms: DataFrame, id_cols, asked=None) -> DataFrame:
    """Smooth idf ln((1+n)/(1+df)) + 1, tf·idf, L2-normalised per document, from written ``terms``.
    All terms meet their frequencies in one pass by term, which only gives the squared
    length of every document.  With ``asked`` (a condition on ``terms``) only terms with
    such a row are given, over the length of the whole document: they are few and are
    found without a shuffle of all terms."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    n = terms.select(*ids).distinct().agg(F.count(F.lit(1)).alias("_n"))
    dfreq = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weigh = lambda x: x.crossJoin(n).withColumn("w", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    # both sides grow with the corpus: sort-merge, never a size-guessed broadcast
    every = weigh(terms.join(dfreq.hint("merge"), "term"))
    norm = every.groupBy(*ids).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    if asked is None:
        kept = every
    else:
        # written, so that their real sizes decide on a broadcast
        own = reliable_checkpoint(terms.filter(asked).select("term").distinct())
        met = reliable_checkpoint(terms.join(own, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df")))
        kept = weigh(terms.join(met, "term"))
    norm = norm.select(*[F.col(c).alias(f"_n_{c}") for c in ids], "_norm")
    same = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in ids]  # documents without an id are one, as in a group
    return kept.join(norm, same).select(*ids, "term", (F.col("w") / F.col("_norm")).alias("w"), "_df")


def _fitted_vectors(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, d_id: str, d_text: str) -> DataFrame:
    """Written (``_src`` q or d, ``_id``, ``term``, ``w``, ``_df``) rows of the terms that some query
    has, fitted on the union of both collections; other terms only count in the lengths."""
    qt = doc_terms(queries.select(F.col(q_id).alias("_id"), F.col(q_text).alias("_x")), "_id", "_x")
    dt = doc_terms(docs.select(F.col(d_id).alias("_id"), F.col(d_text).alias("_x")), "_id", "_x")
    # the source is added behind the terms: a literal among the keys would part the exchange from the counts
    qt, dt = (t.select(F.lit(src).alias("_src"), "_id", "term", "tf") for src, t in (("q", qt), ("d", dt)))
    # every text is tokenised once; frequencies, norms and both sides read the written tables
    terms = reliable_checkpoint(qt.unionByName(dt))
    return reliable_checkpoint(tfidf_vectors(terms, ["_src", "_id"], asked=F.col("_src") == "q"))


def tfidf_similarity(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, d_id: str,
                     d_text: str) -> DataFrame:
    """Cosine similarity of every query document to every document that
    shares at least one term, fitted on the union of both collections."""
    vec = _fitted_vectors(queries, q_id, q_text, docs, d_id, d_text)
    return _all_scores(vec, q_id, queries.schema[q_id].dataType.simpleString(), d_id, docs.schema[d_id].dataType.simpleString())


def _block_scores(schema: pa.Schema):
    """The scores of the pairs of one block of queries and one of documents that share a term."""
    def run(queries: pa.Table, documents: pa.Table) -> pa.Table:
        if not queries.num_rows or not documents.num_rows:
            return schema.empty_table()
        each = [t["_id"].combine_chunks().dictionary_encode(null_encoding="encode") for t in (queries, documents)]
        (q, d), (q_ids, d_ids) = ([x.indices.to_numpy() for x in each], [x.dictionary for x in each])
        terms = pa.chunked_array([*queries["term"].chunks, *documents["term"].chunks]).combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy()
        mine, theirs = code[:len(q)], code[len(q):]
        order = np.argsort(mine, kind="stable")
        q, wq, n = q[order], queries["w"].to_numpy()[order], np.bincount(mine, minlength=len(terms.dictionary))
        begin, wd = np.cumsum(n) - n, documents["w"].to_numpy()
        score = np.zeros(len(q_ids) * len(d_ids))
        met = np.zeros(len(score), bool)
        ends = np.cumsum(n[theirs])  # matches up to each row of a document
        at = 0
        while at < len(d):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MATCHES, "right")))
            many = n[theirs[at:to]]
            row = np.repeat(np.arange(at, to), many)
            own = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[theirs[row]]
            pair = q[own].astype(np.int64) * len(d_ids) + d[row]
            score += np.bincount(pair, wq[own] * wd[row], len(score))
            met[pair] = True
            at = to
        pair = np.flatnonzero(met)
        return pa.table([q_ids.take(pa.array(pair // len(d_ids))), d_ids.take(pa.array(pair % len(d_ids))), pa.array(score[pair])], schema=schema)
    return run


def _all_scores(vec: DataFrame, q_id: str, q_kind: str, d_id: str, d_kind: str) -> DataFrame:
    """(``q_id``, ``d_id``, ``score``) of all pairs that share a term, from written vectors.  Blocks
    of queries meet blocks of documents, so the matches of terms, many a pair, are
    summed where they arise and only vectors are shuffled."""
    size = {r["_src"]: r for r in vec.groupBy("_src").agg(F.count_distinct(F.struct("_id")).alias("ids"), F.count(F.lit(1)).alias("n")).collect()}
    n_q, n_d, rows = (size[s][k] if s in size else 0 for s, k in (("q", "ids"), ("d", "ids"), ("d", "n")))
    q_blocks = max(1, -(-n_q // QUERY_BLOCK))
    d_blocks = max(1, -(-n_d * min(max(n_q, 1), QUERY_BLOCK) // BLOCK_PAIRS), -(-rows // BLOCK_TERMS), -(-shuffle_partitions(vec.sparkSession) // q_blocks))
    block = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(c).alias(c) for c in ("_id", "term", "w")]  # columns of its own for each side
    q = vec.filter(F.col("_src") == "q").select(*own, block(q_blocks).alias("_q"), every(d_blocks).alias("_d"))
    d = vec.filter(F.col("_src") == "d").select(*own, every(q_blocks).alias("_q"), block(d_blocks).alias("_d"))
    # the ids of both sides share a column of the vectors, so they have its type
    kind = vec.schema["_id"].dataType
    schema = to_arrow_schema(StructType([StructField("_qi", kind), StructField("_di", kind), StructField("score", DoubleType())]))
    scores = q.groupBy("_q", "_d").cogroup(d.groupBy("_q", "_d")).applyInArrow(_block_scores(schema), f"_qi {kind.simpleString()}, _di {kind.simpleString()}, score double")
    return scores.select(F.col("_qi").cast(q_kind).alias(q_id), F.col("_di").cast(d_kind).alias(d_id), "score")


def top_similar(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, d_id: str, d_text: str, n: int = 5,
                min_score: float = 0.0, keep=None, digits: int = 9) -> DataFrame:
    """(``q_id``, ``d_id``, ``score``, ``rank``): the ``n`` most similar documents of every query with
    a score (rounded to ``digits``) of ``min_score`` or more, ties by id, without a table of all pairs.

    A query's terms are taken rarest first.  Those that make up half of its
    squared length give partial scores; as no weight is negative, the n-th best
    of them is a lower bound of the n-th best score.  A document that shares
    only terms behind a place has at most the length of the query's vector from
    there on, so terms behind the place where that falls below the bound raise no
    candidates, and candidates whose partial score and that length stay below
    it go.  What is left is scored on the remaining terms.  ``keep`` may filter
    (``q_id``, ``d_id``) rows by conditions of its own; it counts before the ranking."""
    keep = keep or (lambda pairs: pairs)
    vec = _fitted_vectors(queries, q_id, q_text, docs, d_id, d_text)
    own = Window.partitionBy(q_id).orderBy("_df", "term")  # the terms of one query
    q = vec.filter(F.col("_src") == "q").select(F.col("_id").alias(q_id), "term", F.col("w").alias("_wq"), "_df")
    q = reliable_checkpoint(q.withColumn("_left", F.sum(F.col("_wq") * F.col("_wq")).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    d = vec.filter(F.col("_src") == "d").select(F.col("_id").alias(d_id), "term", F.col("w").alias("_wd"))
    part = F.sum(F.col("_wq") * F.col("_wd")).alias("_part")
    slack = 1e-7  # rounding of the sums and of the ranked score
    seeds = keep(q.filter(F.col("_left") > 0.5).join(d, "term").groupBy(q_id, d_id).agg(part))
    best = stats.top_n_per_key(seeds.select(q_id, d_id, "_part"), q_id, [F.desc("_part"), F.col(d_id)], n, rank_col="_r")
    bounds = best.groupBy(q_id).agg(F.max(F.when(F.col("_r") == n, F.col("_part"))).alias("_bound"))
    q = reliable_checkpoint(q.join(bounds, q_id, "left").withColumn("_bound", F.greatest(F.coalesce("_bound", F.lit(0.0)), F.lit(float(min_score))) - slack)
                             .withColumn("_first", F.sqrt("_left") >= F.col("_bound")))
    rest = q.filter(~F.col("_first")).groupBy(q_id).agg(F.sqrt(F.max("_left")).alias("_rest"))
    found = q.filter("_first").join(d, "term").groupBy(q_id, d_id).agg(part, F.max("_bound").alias("_bound"))
    found = found.join(rest, q_id, "left").filter(F.col("_part") + F.coalesce("_rest", F.lit(0.0)) >= F.col("_bound"))
    found = reliable_checkpoint(keep(found.select(q_id, d_id, "_part")).select(q_id, d_id, "_part"))
    late = found.join(q.filter(~F.col("_first")).select(q_id, "term", "_wq"), q_id).join(d, [d_id, "term"]) \
                .groupBy(q_id, d_id).agg(F.sum(F.col("_wq") * F.col("_wd")).alias("_late"))
    scored = found.join(late, [q_id, d_id], "left").select(q_id, d_id, F.round(F.col("_part") + F.coalesce("_late", F.lit(0.0)), digits).alias("score"))
    return top_matches(scored, q_id, d_id, n, min_score)


def top_matches(scores: DataFrame, q_id: str, d_id: str, n: int = 5, min_score: float = 0.0) -> DataFrame:
    """Top-n documents per query with score ≥ min_score (ties by id)."""
    s = scores.filter(F.col("score") >= min_score)
    return stats.top_n_per_key(s, q_id, [F.desc("score"), F.col(d_id)], n, rank_col="rank")
