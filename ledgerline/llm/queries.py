"""Queries of the llm operators: thin digests over each operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, extract, langid, lexical, ngram_join, passages, phrases, pieces, quality, secrets, sharding, simhash, substring
from ledgerline.llm.common import prepare, table
from ledgerline.session import reliable_checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer file (read by the workers from the same place)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    """Ids and round trip of every whole text; see ``pieces.encode_decode``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_decode(docs, tokenizer_path()), "doc_id")


@register("op4_line_frequency", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
          SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
            SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, line, list_filter(string_split_regex(translate(line,
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS lw
      FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
ln AS (SELECT doc_id, host, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
total AS (SELECT host, count(DISTINCT text) AS n_texts FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (
           SELECT ln.host, ln.norm, count(DISTINCT d.text) AS c FROM ln JOIN d USING (doc_id) GROUP BY ALL)
         JOIN total USING (host) WHERE c > 10 AND c > 0.10 * n_texts),
gone AS (SELECT doc_id, count(*) AS lines_gone, sum(n) AS words_gone FROM ln JOIN freq USING (host, norm) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(words_gone, 0) AS words_gone, coalesce(lines_gone, 0) AS lines_gone
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (lines_gone > 0 AND (n_words - words_gone < 10 OR words_gone > 0.7 * n_words)) AS kept,
       lines_gone::BIGINT AS n_removed_lines, words_gone::BIGINT AS n_removed_words
FROM b
""")
def op4_line_frequency(spark, sf_dir):
    """Base rules and cross-document line frequency of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    q = F.col("_quality")
    return quality.line_frequency_rules(docs).select(
        "doc_id", *(q[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                            "base_failed", "kept", "n_removed_lines", "n_removed_words")))


@register("op8_simhash_golay")
def op8_simhash_golay(spark, sf_dir):
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the secret scan over (``doc_id``, ``text``)."""
    scanned = reliable_checkpoint(secrets.scan(docs).drop("text"))
    out = secrets.judge(scanned, secrets.cut_offs(scanned))
    base, spans = F.col("_secrets.base"), F.col("_secrets.all")
    count = lambda k: F.size(F.filter(base, lambda x: x["o"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                      secrets.span_text(spans).alias("spans"))


@register("op6_randomness_battery")
def op6_randomness_battery(spark, sf_dir):
    """Base and random spans of every document."""
    return secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op5_cgk_decontamination")
def op5_cgk_decontamination(spark, sf_dir):
    """Benchmark items found in every document (ids sorted; empty if clean)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"),
                        F.transform("_items", lambda x: x["item_id"]).alias("item_ids"),
                        F.transform("_items", lambda x: x["edits"]).alias("edits"))


@register("op1_best_fit_shards")
def op1_best_fit_shards(spark, sf_dir):
    """Shard and slot of every document, 40 shards of near equal bytes."""
    placed = sharding.into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op2_block_labeller", r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: trim(regexp_replace(
        replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br/?>', ' ', 'g'), '<[^<>]*>', '', 'g'),
          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
        '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
""")
def op2_block_labeller(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract.main_text(pages, extract.fit(pages))
    return found.select("page_id", "url", F.col("_main.text").alias("text"),
                        F.length("_main.text").cast("long").alias("n_chars"))


@register("op3_bwt_substrings", r"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, doc_id, length(x) // 2 AS n, unnest(range(0, length(x) // 2)) AS p, x FROM h),
w AS (SELECT r, doc_id, p, CASE WHEN p + 50 <= n THEN substr(x, 2 * p + 1, 100) END AS s, substr(x, 2 * p + 1, 2) AS b FROM p),
o AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
f AS (SELECT w.r, w.p, w.b, coalesce(o.first < w.doc_id, false) AS hit FROM w LEFT JOIN o ON o.s = w.s),
g AS (SELECT r, p, b, coalesce(max(CASE WHEN hit THEN p END) OVER (PARTITION BY r ORDER BY p) > p - 50, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM g),
a AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
             coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN a USING (r)
""")
def op3_bwt_substrings(spark, sf_dir):
    """Bytes of every document that earlier documents already hold."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes",
                      F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"]).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op7_compact_windows")
def op7_compact_windows(spark, sf_dir):
    """Class of every document by near-duplicate passages of 50 words or more."""
    out = passages.passage_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def held_out(id_col: str = "doc_id"):
    """True for rows that no model may learn from; a null id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@register("op10_viterbi_language")
def op10_viterbi_language(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang.lang").alias("lang_pred"),
                        F.col("_lang.score").alias("score"), F.size("_lang.spans").alias("n_spans"))


@register("op11_son_phrases", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) s(size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
d AS (SELECT lang, phrase, max(a) AS within FROM (
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
x AS (SELECT c.lang, c.phrase, a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2
      FROM c LEFT JOIN d USING (lang, phrase), (VALUES (1), (2)) t(k)
      WHERE k < size AND (within IS NULL OR 100 * within < 50 * a)),
s AS (SELECT x.lang, x.phrase, a, k, f1.f AS l, f2.f AS r, (1000000::HUGEINT * a * a // (f1.f::HUGEINT * f2.f))::BIGINT AS score
      FROM x JOIN f f1 ON f1.lang = x.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = x.lang AND f2.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
""")
def op11_son_phrases(spark, sf_dir):
    """The 2,000 best collocations of two or three words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@register("op12_partenum_join")
def op12_partenum_join(spark, sf_dir):
    """Component of every document by shingle sets of Jaccard similarity 0.9 or more."""
    out = ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=90)
    return out.withColumnRenamed("id", "doc_id")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op13_ranked_search", f"""
WITH t AS (SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n) AS total FROM d),
q AS (SELECT i, item_id, term, count(*) AS times FROM (
        SELECT i, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
x AS (SELECT q.i, q.item_id, f.r, d.doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank FROM x WHERE score > 0) WHERE rank <= 10
""")
def op13_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.best_documents(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@register("pipeline")
def pipeline(spark, sf_dir):
    """The corpus pipeline's result; see ``corpus_pipeline.py``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
