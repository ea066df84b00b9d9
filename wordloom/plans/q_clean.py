"""Registered queries: phrase substitution and spelling correction over the documents.

The phrase table is the built-in abbreviation map plus a small parameter
list of common phrases found in the English documents.  The spelling
dictionary is the word frequency table of ``benchmark`` (whose passages
also appear inside the documents), so unknown document words near a
benchmark word get corrected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import clean as CL
from wordloom.operators import tokens as TK
from wordloom.plans.common import load, sql_normalize

# Extra phrase entries for the documents (parameter of the query, like a synonym file).
EXTRA_PHRASES = [("of the", "ofthe"), ("on the", "onthe"), ("the", "THE"), ("and", "&"),
                 ("with", "w/"), ("is and", "isand"), ("it is", "its"), ("from the", "fromthe")]


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.normalize("text").alias("t"))


def dictionary(spark, sf):
    b = TK.explode_with_pos(load(spark, sf, "benchmark"), [], CL.spell_words(T.normalize("text")), "_p", "word")
    return b.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def q_synonym_map(spark, sf):
    """CLN-2 / JOIN-2 / ORD-1 over every document."""
    phrases = CL.synonym_table(spark, EXTRA_PHRASES)
    r = CL.replace_phrases(_docs(spark, sf), "doc_id", "t", phrases, out="cleaned")
    return r.select("doc_id", F.length("cleaned").cast("bigint").alias("n_chars"), F.md5("cleaned").alias("text_md5"))


def q_spell_candidates(spark, sf):
    """JOIN-5 / JOIN-7: correction of every unknown eligible document word."""
    words = TK.explode_with_pos(_docs(spark, sf), [], CL.spell_words("t"), "_p", "word")
    c = CL.spell_candidates(words, dictionary(spark, sf), max_distance=2)
    return c.select("word", "correction", "distance", F.col("freq").cast("bigint").alias("freq"))


def q_spell_correct(spark, sf):
    """CLN-5: every document with its unknown words corrected."""
    r = CL.spell_correct(_docs(spark, sf), "doc_id", "t", dictionary(spark, sf), max_distance=2)
    return r.select("doc_id", F.md5("corrected").alias("text_md5"), F.col("n_words").cast("bigint").alias("n_words"),
                    F.col("n_corrected").cast("bigint").alias("n_corrected"))


QUERIES = {
    "synonym_map": q_synonym_map,
    "spell_candidates": q_spell_candidates,
    "spell_correct": q_spell_correct,
}


def _re2_escape(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def _synonym_sql() -> str:
    from wordloom import fixed
    rows = []
    seen = {}
    for i, (p, t) in enumerate(EXTRA_PHRASES + [(p, t) for p, t in fixed.BUILTIN_SYNONYMS]):
        key = " ".join(p.lower().split())
        if key in seen:
            seen[key] = (seen[key][0], t)
        else:
            seen[key] = (i, t)
    rows = sorted(((-len(k), pos, k, t) for k, (pos, t) in seen.items()))
    # Phrase by phrase, longest first; a replaced place becomes a mark that no phrase matches.  A word
    # boundary is asked for only at an edge that is a word character.
    expr, marks = "t", []
    for i, (_, _, k, tgt) in enumerate(rows):
        pat = ("\\b" if k[0].isalnum() else "") + _re2_escape(k) + ("\\b" if k[-1].isalnum() else "")
        expr = f"regexp_replace({expr}, '{pat.replace(chr(39), chr(39) * 2)}', chr(2) || '{i}' || chr(3), 'g')"
        marks.append((i, tgt.replace("'", "''")))
    for i, tgt in marks:
        expr = f"replace({expr}, chr(2) || '{i}' || chr(3), '{tgt}')"
    out = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    return f"""
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS text_md5 FROM (
  SELECT doc_id, {out} AS c FROM (SELECT doc_id, {sql_normalize('text')} AS t FROM documents))"""


def _spell_words_sql(x: str) -> str:
    padded = f"regexp_replace(regexp_replace({x}, '([\"/:\\[\\]().,''\\\\])', ' \\1 ', 'g'), '\\s+', ' ', 'g')"
    return f"(CASE WHEN trim({padded}) = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim({padded}), '\\s+') END)"


_DELS = ("list_distinct(list_concat([{w}], list_transform(range(1, greatest(length({w}), 1) + 1), "
         "lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))))")

_SPELL = f"""
dw AS (SELECT unnest({_spell_words_sql(sql_normalize('text'))}) AS word FROM benchmark),
dict AS (SELECT word AS cand, count(*) AS freq FROM dw WHERE regexp_matches(word, '^[a-z]+$') GROUP BY word),
dwords AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, {_spell_words_sql(sql_normalize('text'))} AS ws FROM documents)
),
vocab AS (SELECT DISTINCT word FROM dwords WHERE regexp_matches(word, '\\w') AND NOT regexp_matches(word, '[0-9]')),
unknown AS (SELECT word FROM vocab WHERE word NOT IN (SELECT cand FROM dict)),
u1 AS (SELECT word, unnest({_DELS.format(w='word')}) AS d1 FROM unknown WHERE length(word) <= (SELECT max(length(cand)) + 2 FROM dict)),
d1 AS (SELECT cand, freq, unnest({_DELS.format(w='cand')}) AS d1 FROM dict),
uk AS (SELECT DISTINCT word, dkey FROM (SELECT word, unnest({_DELS.format(w='d1')}) AS dkey FROM u1)),
dk AS (SELECT DISTINCT cand, freq, dkey FROM (SELECT cand, freq, unnest({_DELS.format(w='d1')}) AS dkey FROM d1)),
pairs AS (SELECT DISTINCT uk.word, dk.cand, dk.freq FROM uk JOIN dk ON uk.dkey = dk.dkey),
scored AS (
  SELECT word, cand, freq, damerau_levenshtein(word, cand) AS distance FROM pairs
  WHERE damerau_levenshtein(word, cand) <= 2
),
best AS (
  SELECT word, cand AS correction, CAST(distance AS INT) AS distance, CAST(freq AS BIGINT) AS freq
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, cand) AS rn FROM scored)
  WHERE rn = 1
)"""


def sql() -> dict[str, str]:
    return {
        "synonym_map": _synonym_sql(),
        "spell_candidates": f"WITH {_SPELL} SELECT word, correction, distance, freq FROM best",
        "spell_correct": f"""WITH {_SPELL},
per AS (
  SELECT w.doc_id, string_agg(coalesce(b.correction, w.word), ' ' ORDER BY w.pos) AS c,
         count(*) AS n_words, count(b.correction) AS n_corrected
  FROM dwords w LEFT JOIN best b ON w.word = b.word GROUP BY w.doc_id
)
SELECT d.doc_id, md5(coalesce(per.c, '')) AS text_md5, CAST(coalesce(per.n_words, 0) AS BIGINT) AS n_words,
       CAST(coalesce(per.n_corrected, 0) AS BIGINT) AS n_corrected
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id""",
    }
