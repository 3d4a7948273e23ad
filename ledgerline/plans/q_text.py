"""Text analyses over the full ``documents`` texts (CVs / reviews) and
``benchmark`` (job descriptions as query documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import text as TX
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_nums(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


# The generated prose holds no skill, degree or opinion words, so texts read as
# CVs or reviews get a phrase chosen by their key (the same on both sides);
# every eleventh also gets mixed opinions in proportion to its length.
PHRASES = [
    "Skilled in Python, C++, C#, SQL and AWS; 7 years of experience. Bachelor of Science",
    "Docker, Kubernetes, Git, Agile; worked for 3.5 years. University of Paris",
    "experience: twelve years in Machine Learning and NLP. MSc in Physics",
    "The service was bad and the staff awful, I hate the delivery time",
    "Great price, excellent quality, I love the product support",
    "I am afraid, scared and worried about the error",
    "Node.js, .NET, ASP.NET, Ruby on Rails, CI/CD and REST API",
    "",
    "good price but terrible service",
]


def phrased(key: str, text: str = "text"):
    """``text`` with the phrase of its key."""
    pick = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.pmod(F.col(key), F.lit(len(PHRASES))) + 1).cast("int"))
    mixed = F.when(F.col(key) % 11 == 0, F.repeat(F.lit(" great awful"), F.floor(F.length(text) / 10).cast("int"))).otherwise("")
    return F.concat(F.col(text), F.lit(" "), pick, mixed)


def _phrased_sql(key: str, source: str) -> str:
    return (f"(SELECT {key}, text || ' ' || {_sql_list(PHRASES)}[CAST({key} % {len(PHRASES)} AS BIGINT) + 1] || "
            f"CASE WHEN {key} % 11 = 0 THEN repeat(' great awful', CAST(length(text) // 10 AS BIGINT)) ELSE '' END AS text FROM {source})")


PROFILES = _phrased_sql("doc_id", "documents")


def profiles(spark, d):
    return docs(spark, d).withColumn("text", phrased("doc_id"))


_STOP = _sql_list(T.STOP_WORDS)
_WORD = r"[\p{L}\p{N}_]"


@register("clean_text", sql=r"""
SELECT doc_id, length(c) AS cleaned_length, md5(c) AS cleaned_md5
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'),
                                         '[^\p{L}\p{N}_ \t\n\x0B\f\r@,-:;]', '', 'g')) AS c FROM documents)""")
def q_clean_text(spark, d):
    c = T.clean_text(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(c).alias("cleaned_length"), F.md5(c).alias("cleaned_md5"))


@register("tokenize", sql=f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct_tokens
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: NOT list_contains({_STOP}, x)) AS t
      FROM documents)""")
def q_tokenize(spark, d):
    t = T.tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct_tokens"))


@register("word_stats", sql=f"""
SELECT doc_id, len(w) AS word_count,
       round(CASE WHEN len(w) = 0 THEN 0.0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS avg_word_length
FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}+') AS w FROM documents)""")
def q_word_stats(spark, d):
    w = T.words(F.col("text"))
    total = F.aggregate(F.transform(w, lambda x: F.length(x)), F.lit(0), lambda a, v: a + v)
    return docs(spark, d).select("doc_id", F.size(w).alias("word_count"),
                                 F.round(F.when(F.size(w) == 0, 0.0).otherwise(total / F.size(w)), 6).alias("avg_word_length"))


@register("detect_language", sql=f"""
SELECT doc_id, CASE WHEN len(w) = 0 THEN 'unknown'
                    WHEN len(list_intersect(w, {_sql_list(T.ENGLISH_MARKERS)})) > 0 THEN 'en' ELSE 'unknown' END AS language
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}+') AS w FROM documents)""")
def q_detect_language(spark, d):
    return docs(spark, d).select("doc_id", T.detect_language(F.col("text")).alias("language"))


def _first(pattern):
    return f"nullif(regexp_extract(text, '{pattern}', 0), '')"


@register("extract_contacts", sql=f"""
SELECT doc_id, {_first(T.EMAIL_PATTERN)} AS email,
       coalesce({_first(T.PHONE_PATTERNS[0])}, {_first(T.PHONE_PATTERNS[1])}) AS phone
FROM documents""")
def q_extract_contacts(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.email(t).alias("email"), T.phone(t).alias("phone"))


def _exp_sql():
    nums = [f"list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda x: TRY_CAST(x AS DOUBLE))"
            for p in T.EXPERIENCE_NUMERIC]
    keys = _sql_list(T.NUMBER_WORDS)
    vals = _sql_nums(range(1, 21))
    wrd = [f"list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda x: {vals}[list_position({keys}, lower(x))])"
           for p in T.EXPERIENCE_WORDS]
    allv = "list_filter(flatten([" + ", ".join(nums + wrd) + "]), lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({allv}) > 0 THEN list_max({allv}) END"


@register("extract_experience_years", sql=f"SELECT doc_id, {_exp_sql()} AS experience_years FROM {PROFILES}")
def q_experience(spark, d):
    return profiles(spark, d).select("doc_id", T.experience_years(F.col("text")).alias("experience_years"))


def _skills_sql():
    parts = [f"CASE WHEN regexp_matches(text, '{T.skill_regex(s)}') THEN '{s}' END" for s in T.COMMON_SKILLS]
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ',')"


@register("extract_skills", sql=f"SELECT doc_id, {_skills_sql()} AS skills FROM {PROFILES}")
def q_extract_skills(spark, d):
    return profiles(spark, d).select("doc_id", F.array_join(T.extract_skills(F.col("text")), ",").alias("skills"))


def _category_sql(col):
    whens = " ".join(f"WHEN {col} IN ({', '.join(repr(s) for s in names)}) THEN '{cat}'"
                     for cat, names in T.SKILL_CATEGORIES.items())
    return f"CASE {whens} ELSE 'other' END"


@register("categorize_skills", sql=f"""
SELECT {_category_sql('skill')} AS category, skill, count(*) AS documents
FROM (SELECT unnest(string_split({_skills_sql()}, ',')) AS skill FROM {PROFILES}) WHERE skill <> '' GROUP BY ALL""")
def q_categorize_skills(spark, d):
    s = profiles(spark, d).select(F.explode_outer(T.extract_skills(F.col("text"))).alias("skill")).filter(F.col("skill").isNotNull())
    return s.groupBy(T.skill_category(F.col("skill")).alias("category"), "skill").agg(F.count(F.lit(1)).alias("documents"))


@register("extract_education", sql="""
SELECT doc_id, len(regexp_extract_all(text, '""" + T.EDUCATION_PATTERNS[0] + """', 0))
             + len(regexp_extract_all(text, '""" + T.EDUCATION_PATTERNS[1] + """', 0)) AS education_mentions FROM """ + PROFILES)
def q_education(spark, d):
    return profiles(spark, d).select("doc_id", F.size(T.education(F.col("text"))).alias("education_mentions"))


# ------------------------------------------------------------------ sentiment

_KEYS = _sql_list(list(TX.LEXICON))
_VALS = _sql_nums([v[0] for v in TX.LEXICON.values()])
_SUBJ = _sql_nums([v[1] for v in TX.LEXICON.values()])

_SENT_CTE = f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{_WORD}+') AS ws FROM {PROFILES}),
v AS (SELECT doc_id, text, len(ws) AS nw,
             list_filter(list_transform(ws, lambda x: {_VALS}[list_position({_KEYS}, x)]), lambda v: v IS NOT NULL) AS hits,
             list_filter(list_transform(ws, lambda x: {_SUBJ}[list_position({_KEYS}, x)]), lambda v: v IS NOT NULL) AS sh FROM w),
a AS (SELECT doc_id, text, len(hits) AS nh, coalesce(list_sum(hits), 0.0) AS s, coalesce(list_sum(sh), 0.0) AS subj,
             coalesce(list_sum(list_transform(list_filter(hits, lambda v: v > 0), lambda v: v + 1)), 0.0) AS ps,
             coalesce(list_sum(list_transform(list_filter(hits, lambda v: v < 0), lambda v: v - 1)), 0.0) AS ns,
             CAST(nw - len(hits) AS DOUBLE) AS neu_cnt FROM v),
sc AS (SELECT doc_id, text,
              CASE WHEN ps - ns + neu_cnt = 0 THEN 0.0 ELSE -ns / (ps - ns + neu_cnt) END AS neg,
              CASE WHEN ps - ns + neu_cnt = 0 THEN 1.0 ELSE neu_cnt / (ps - ns + neu_cnt) END AS neu,
              CASE WHEN ps - ns + neu_cnt = 0 THEN 0.0 ELSE ps / (ps - ns + neu_cnt) END AS pos,
              s / sqrt(s * s + 15.0) AS compound,
              CASE WHEN nh = 0 THEN 0.0 ELSE least(1.0, greatest(-1.0, s / 4.0 / nh)) END AS polarity,
              CASE WHEN nh = 0 THEN 0.0 ELSE subj / nh END AS subjectivity FROM a),
lab AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
               CASE WHEN abs(compound) > 0.75 THEN 0.9 + (abs(compound) - 0.75) * 0.4
                    WHEN abs(compound) > 0.5 THEN 0.7 + (abs(compound) - 0.5) * 0.8
                    WHEN abs(compound) > 0.25 THEN 0.5 + (abs(compound) - 0.25) * 0.8
                    ELSE 0.3 + abs(compound) * 0.8 END AS confidence,
               length(text) - length(replace(text, '!', '')) AS excl, length(text) - length(replace(text, '?', '')) AS ques
        FROM sc),
emo AS (SELECT *, CASE WHEN polarity > 0.3 THEN least(1.0, polarity * 1.5) ELSE 0.0 END AS joy,
               CASE WHEN polarity < -0.3 THEN least(1.0, abs(polarity) * 1.2) ELSE 0.0 END AS sadness,
               CASE WHEN polarity < -0.3 THEN least(1.0, abs(polarity) * subjectivity) ELSE 0.0 END AS anger,
               CAST(CASE WHEN ques > 0 THEN least(1.0, ques * 0.1) WHEN excl > 0 THEN least(1.0, excl * 0.2) ELSE 0.0 END AS DOUBLE) AS surprise,
               CAST(least(1.0, {' + '.join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN 0.3 ELSE 0.0 END" for w in T.FEAR_WORDS)}) AS DOUBLE) AS fear
        FROM lab)
"""


def scored(spark, d):
    return TX.sentiment_analyze(profiles(spark, d), "text")


@register("sentiment_lexicon", sql=_SENT_CTE + """
SELECT doc_id, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos, round(compound, 6) AS compound FROM sc""")
def q_sentiment_lexicon(spark, d):
    s = TX.sentiment_scores(profiles(spark, d), "text")
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("neg", "neu", "pos", "compound")])


_MODIFIED = "CASE doc_id % 6 WHEN 0 THEN ' it is not good' WHEN 1 THEN ' this was really very bad' WHEN 2 THEN ' never a problem, so slightly happy' " \
            "WHEN 3 THEN ' NOT the most terrible, great' ELSE '' END"
_MOD_ROWS = ", ".join(f"('{w}', {0.0 if b is None else b}, {str(b is None).lower()})" for w, b in TX.MODIFIERS.items())


@register("sentiment_negation", sql=f"""
WITH lex(w, v, sj) AS (VALUES {", ".join(f"('{w}', {float(v)}, {float(sj)})" for w, (v, sj) in TX.LEXICON.items())}),
mods(m, b, neg) AS (VALUES {_MOD_ROWS}),
t AS (SELECT doc_id, regexp_extract_all(lower(text || {_MODIFIED}), '{_WORD}+') AS ws FROM {PROFILES}),
x AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws FROM t),
h AS (SELECT x.doc_id, v, sj, coalesce(m1.b, 0.0) + coalesce(m2.b, 0.0) * 0.95 + coalesce(m3.b, 0.0) * 0.9 AS b,
             coalesce(m1.neg, false) OR coalesce(m2.neg, false) OR coalesce(m3.neg, false) AS neg
      FROM x JOIN lex ON lex.w = x.w LEFT JOIN mods m1 ON i > 1 AND m1.m = ws[i - 1]
      LEFT JOIN mods m2 ON i > 2 AND m2.m = ws[i - 2] LEFT JOIN mods m3 ON i > 3 AND m3.m = ws[i - 3]),
y AS (SELECT doc_id, sj, (v + sign(v) * b) * CASE WHEN neg THEN -0.74 ELSE 1.0 END AS v FROM h),
g AS (SELECT doc_id, sum(v) AS s, coalesce(sum(v + 1) FILTER (v > 0), 0.0) AS ps, coalesce(sum(v - 1) FILTER (v < 0), 0.0) AS ns, count(*) AS nh, sum(sj) AS subj
      FROM y GROUP BY doc_id),
f AS (SELECT t.doc_id, coalesce(s, 0.0) AS s, coalesce(ps, 0.0) AS ps, coalesce(ns, 0.0) AS ns, coalesce(nh, 0) AS nh, coalesce(subj, 0.0) AS subj,
             len(ws) - coalesce(nh, 0) AS neu FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, round(CASE WHEN ps - ns + neu = 0 THEN 0.0 ELSE -ns / (ps - ns + neu) END, 6) AS neg, round(CASE WHEN ps - ns + neu = 0 THEN 0.0 ELSE ps / (ps - ns + neu) END, 6) AS pos,
       round(s / sqrt(s * s + 15.0), 6) AS compound, round(CASE WHEN nh = 0 THEN 0.0 ELSE least(1.0, greatest(-1.0, s / 4.0 / nh)) END, 6) AS polarity,
       round(CASE WHEN nh = 0 THEN 0.0 ELSE subj / nh END, 6) AS subjectivity FROM f""")
def q_sentiment_negation(spark, d):
    """Scores by a lexicon table with boosters and negations in the three words before a hit."""
    lexicon = TX.lexicon_table(spark).toDF("word", "valence", "subjectivity")
    x = profiles(spark, d).select("doc_id", F.concat("text", F.expr(_MODIFIED)).alias("text"))
    s = TX.sentiment_scores(x, "text", lexicon=lexicon, modifiers=TX.modifier_table(spark))
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("neg", "pos", "compound", "polarity", "subjectivity")])


@register("sentiment_analyze", sql=_SENT_CTE + """
SELECT doc_id, sentiment_label, round(confidence, 5) AS confidence, round(polarity, 5) AS polarity,
       round(joy, 5) AS joy, round(sadness, 5) AS sadness, round(anger, 5) AS anger, round(surprise, 5) AS surprise,
       round(fear, 5) AS fear FROM emo""", headline=True)
def q_sentiment_analyze(spark, d):
    s = scored(spark, d)
    return s.select("doc_id", "sentiment_label",
                    *[F.round(c, 5).alias(c) for c in ("confidence", "polarity", "joy", "sadness", "anger", "surprise", "fear")])


@register("sentiment_summary", sql=_SENT_CTE + """
SELECT count(*) AS texts,
       round(count(*) FILTER (WHERE sentiment_label = 'positive') / count(*), 6) AS positive_share,
       round(count(*) FILTER (WHERE sentiment_label = 'negative') / count(*), 6) AS negative_share,
       round(count(*) FILTER (WHERE sentiment_label = 'neutral') / count(*), 6) AS neutral_share,
       round(avg(compound), 6) AS avg_compound, round(avg(confidence), 6) AS avg_confidence,
       round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence,
       round(avg(joy), 6) AS avg_joy, round(avg(surprise), 6) AS avg_surprise, round(avg(fear), 6) AS avg_fear FROM emo""")
def q_sentiment_summary(spark, d):
    s = TX.sentiment_summary(scored(spark, d))
    return s.select("texts", *[F.round(c, 6).alias(c) for c in s.columns if c != "texts"])


@register("sentiment_daily", sql=_SENT_CTE + """
SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date, round(avg(compound), 6) AS avg_compound,
       count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment_label = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral FROM lab GROUP BY 1""")
def q_sentiment_daily(spark, d):
    # documents carry no date: a publication day is derived from the id
    s = scored(spark, d).withColumn("published", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")))
    return TX.sentiment_daily(s, "published").withColumn("avg_compound", F.round("avg_compound", 6))


# ------------------------------------------------------------------ TF-IDF

_TFIDF_CTE = f"""
WITH docs AS (SELECT 'q' AS src, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
tk AS (SELECT src, id, list_filter(regexp_extract_all(lower(text), '{_WORD}{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS t FROM docs),
terms AS (SELECT src, id, unnest(t || CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS term FROM tk),
tf AS (SELECT src, id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT src, id FROM tf)),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT src, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (term), n),
nv AS (SELECT src, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY src, id)) AS w FROM w),
sim AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.w * d.w) AS score
        FROM nv q JOIN nv d ON q.term = d.term WHERE q.src = 'q' AND d.src = 'd' GROUP BY 1, 2)
"""


def similarity(spark, d):
    return TX.tfidf_similarity(table(spark, d, "benchmark"), "item_id", "text", docs(spark, d), "doc_id", "text")


@register("cv_similarity", sql=_TFIDF_CTE + "SELECT item_id, doc_id, round(score, 6) AS score FROM sim", headline=True)
def q_cv_similarity(spark, d):
    return similarity(spark, d).withColumn("score", F.round("score", 6))


@register("cv_topn", sql=_TFIDF_CTE + """
SELECT item_id, doc_id, rank FROM
  (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
   FROM sim WHERE score >= 0.05) WHERE rank <= 5""")
def q_cv_topn(spark, d):
    s = TX.top_similar(table(spark, d, "benchmark"), "item_id", "text", docs(spark, d), "doc_id", "text", 5, 0.05)
    return s.select("item_id", "doc_id", F.col("rank").cast("long"))


@register("cv_analyze", sql=f"""
SELECT doc_id, len(regexp_extract_all(trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'),
                                         '[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0B\\f\\r@,-:;]', '', 'g')), '{_WORD}+')) AS word_count,
       {_skills_sql()} AS skills, {_exp_sql()} AS experience_years,
       {_first(T.EMAIL_PATTERN)} AS email,
       coalesce({_first(T.PHONE_PATTERNS[0])}, {_first(T.PHONE_PATTERNS[1])}) AS phone
FROM {PROFILES}""")
def q_cv_analyze(spark, d):
    p = TX.cv_profile(profiles(spark, d), "doc_id", "text")
    return p.select("doc_id", "word_count", F.array_join("skills", ",").alias("skills"), "experience_years", "email", "phone")
