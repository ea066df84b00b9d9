"""Registered queries: cleaning, tokenising and token shapes (documents, pages, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import shape as S
from wordloom.functions import text as T
from wordloom.operators import features as FE
from wordloom.operators import tokens as TK
from wordloom.plans.common import load, sql_ascii, sql_normalize, sql_tokens

NL = "\n"


def q_ascii_normalize(spark, sf):
    """CLN-1 + CLN-8 + CLN-3 on every document."""
    d = load(spark, sf, "documents")
    n = T.normalize("text")
    return d.select("doc_id", F.length(n).cast("bigint").alias("n_chars"),
                    F.md5(n).alias("text_md5"))


def q_punctuation_pad(spark, sf):
    """CLN-4 then CLN-3 on ASCII text."""
    d = load(spark, sf, "documents")
    p = T.squeeze_spaces(T.pad_punctuation(T.ascii_only("text")))
    return d.select("doc_id", F.length(p).cast("bigint").alias("n_chars"), F.md5(p).alias("text_md5"))


def q_digit_letter_split(spark, sf):
    """TOK-1 on raw web pages (markup has many digit-letter pairs)."""
    p = load(spark, sf, "pages")
    s = T.split_digit_letter(T.ascii_only("html"))
    return p.select("page_id", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("html_md5"))


def q_tokenize(spark, sf):
    """TOK-2 on normalised documents: token count and a digest of the token list."""
    d = TK.with_tokens(load(spark, sf, "documents").select("doc_id", T.normalize("text").alias("t")), "t")
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("tokens", NL)).alias("tokens_md5"))


def q_conversation_tokens(spark, sf):
    """TOK-2 on conversation turns, case kept."""
    c = load(spark, sf, "conversations")
    tk = T.tokenize(T.ascii_only("text"))
    return c.select("conv_id", "turn", F.size(tk).cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join(tk, NL)).alias("tokens_md5"))


def q_token_counts(spark, sf):
    """Corpus token frequencies over all normalised documents."""
    return TK.token_counts(load(spark, sf, "documents"), "text").select(
        "token", F.col("n").cast("bigint").alias("n"))


def q_token_shape(spark, sf):
    """FEA-1..FEA-9 on every distinct raw (case-kept) token of the documents."""
    d = load(spark, sf, "documents")
    toks = TK.explode_with_pos(d, [], T.tokenize(T.ascii_only("text")), "_p", "token").select("token").distinct()
    t = F.col("token")
    return toks.select(
        "token",
        S.token_length(t).cast("int").alias("length"),
        S.has_vowels(t).cast("int").alias("has_vowels"),
        S.has_period(t).cast("int").alias("period"),
        S.ends_with_comma(t).cast("int").alias("comma"),
        S.possessive(t).cast("int").alias("possessive"),
        S.trailing_zeros(t).alias("trailing_zeros"),
        S.digits(t).alias("digits"),
        S.casing(t).alias("casing"),
        T.clean_token(t).alias("token_clean"),
        T.abbrev_token(t).alias("token_abbrev"),
        *[f(t).cast("string").alias(name.replace(".", "_")) for name, f in S.OPTIONAL_FEATURES.items()
          if name not in ("digits", "case", "trailing.zeros")],
    )


def q_gazetteer_flags(spark, sf):
    """JOIN-3 over all document tokens plus part names: per distinct token the three memberships."""
    d = load(spark, sf, "documents").select(T.normalize("text").alias("t"))
    p = load(spark, sf, "part").select(T.normalize("p_name").alias("t"))
    toks = d.unionByName(p).transform(lambda u: TK.explode_with_pos(u, [], T.tokenize("t"), "_p", "token")).select("token").distinct()
    out = FE.gazetteer_flags(toks, "token")
    return out.select("token", F.col("is_location").cast("int").alias("is_location"),
                      F.col("is_object").cast("int").alias("is_object"),
                      F.col("prepositions").cast("int").alias("prepositions"))


def q_stopword_filter(spark, sf):
    """TOK-6: words of every document left after removal of English stopwords."""
    d = load(spark, sf, "documents")
    w = d.select("doc_id", T.space_split(T.normalize("text")).alias("words"))
    k = TK.remove_stopwords(w, "words", "kept")
    return k.select("doc_id", F.size("words").cast("bigint").alias("n_words"),
                    F.size("kept").cast("bigint").alias("n_kept"),
                    F.md5(F.array_join("kept", " ")).alias("kept_md5"))


def q_ngrams_longest_first(spark, sf):
    """TOK-5 over part names and conversation turns: every 1-4-gram with its longest-first rank."""
    c = load(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("sid"),
        T.space_split(T.normalize("text")).alias("w"))
    p = load(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("sid"),
        T.space_split(T.normalize("p_name")).alias("w"))
    g = TK.explode_ngrams(c.unionByName(p), "sid", "w")
    return g.select("sid", F.col("ord").cast("int").alias("ord"), F.col("n").cast("int").alias("n"),
                    F.col("start").cast("int").alias("start"), "gram")


def part_lexicon(spark, sf):
    """``(word, tag, ord)``: last word of a part name is a noun (NN), earlier words adjectives (JJ)."""
    p = load(spark, sf, "part").select("p_partkey", T.space_split(T.normalize("p_name")).alias("w"))
    e = TK.explode_with_pos(p.withColumn("n", F.size("w")), ["p_partkey", "n"], "w", "i", "word")
    return e.select("word", F.when(F.col("i") == F.col("n") - 1, "NN").otherwise("JJ").alias("tag"),
                    (F.col("p_partkey") * 100 + F.col("i")).alias("ord")).distinct()


def q_token_pos(spark, sf):
    """JOIN-4: noun count, verb count and last tag of every distinct conversation and part token."""
    c = load(spark, sf, "conversations").select(T.normalize("text").alias("t"))
    p = load(spark, sf, "part").select(T.normalize("p_name").alias("t"))
    toks = c.unionByName(p).transform(lambda u: TK.explode_with_pos(u, [], T.tokenize("t"), "_p", "token")).select("token").distinct()
    out = FE.with_pos(toks, "token", part_lexicon(spark, sf))
    return out.select("token", F.col("nouns_count").cast("int").alias("nouns_count"),
                      F.col("verbs_count").cast("int").alias("verbs_count"), "nltk_tag")


def _stop_sql() -> str:
    words = TK.english_stopwords()
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _ngram_sql() -> str:
    # one row per (sid, n, start); ord = rank in the longest-first order
    return """
WITH src AS (
  SELECT 'c' || conv_id::VARCHAR || '_' || turn::VARCHAR AS sid, {nc} AS t FROM conversations
  UNION ALL
  SELECT 'p' || p_partkey::VARCHAR AS sid, {np} AS t FROM part
), w AS (
  SELECT sid, CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(t, '\\s+') END AS w FROM src
), g AS (
  SELECT sid, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS start
  FROM w, (VALUES (4),(3),(2),(1)) v(n)
)
SELECT sid,
  CAST((CASE WHEN n < 4 THEN greatest(len(w) - 3, 0) ELSE 0 END)
     + (CASE WHEN n < 3 THEN greatest(len(w) - 2, 0) ELSE 0 END)
     + (CASE WHEN n < 2 THEN greatest(len(w) - 1, 0) ELSE 0 END) + start AS INT) AS ord,
  CAST(n AS INT) AS n, CAST(start AS INT) AS start, array_to_string(w[start + 1:start + n], ' ') AS gram
FROM g
""".format(nc=sql_normalize("text"), np=sql_normalize("p_name"))


QUERIES = {
    "ascii_normalize": q_ascii_normalize,
    "punctuation_pad": q_punctuation_pad,
    "digit_letter_split": q_digit_letter_split,
    "tokenize": q_tokenize,
    "conversation_tokens": q_conversation_tokens,
    "token_counts": q_token_counts,
    "token_shape": q_token_shape,
    "gazetteer_flags": q_gazetteer_flags,
    "stopword_filter": q_stopword_filter,
    "ngrams_longest_first": q_ngrams_longest_first,
    "token_pos": q_token_pos,
}


def sql() -> dict[str, str]:
    nt = sql_normalize("text")
    tok_doc = sql_tokens(nt)
    from wordloom import fixed
    loc = ", ".join("'" + w.replace("'", "''") + "'" for w in fixed.LOCATIONS)
    obj = ", ".join("'" + w.replace("'", "''") + "'" for w in fixed.OBJECTS)
    prep = ", ".join("'" + w + "'" for w in fixed.PREPOSITIONS)
    clean = ("CASE WHEN token = '&' THEN token ELSE "
             "regexp_replace(lower(token), '^\\W*|[^.\\w]*$', '', 'g') END")
    abbrev = f"CASE WHEN token = '&' THEN token ELSE regexp_replace({clean}, '\\W', '', 'g') END"
    return {
        "ascii_normalize": f"""
SELECT doc_id, CAST(length({nt}) AS BIGINT) AS n_chars, md5({nt}) AS text_md5 FROM documents""",
        "punctuation_pad": f"""
SELECT doc_id, CAST(length(p) AS BIGINT) AS n_chars, md5(p) AS text_md5 FROM (
  SELECT doc_id, regexp_replace(regexp_replace({sql_ascii('text')},
         '(["/:\\[\\]().,''\\\\])', ' \\1 ', 'g'), '\\s+', ' ', 'g') AS p FROM documents)""",
        "digit_letter_split": f"""
SELECT page_id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS html_md5 FROM (
  SELECT page_id, regexp_replace({sql_ascii('html')}, '([0-9])([a-zA-Z])', '\\1 \\2', 'g') AS s FROM pages)""",
        "tokenize": f"""
SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, md5(array_to_string(tk, chr(10))) AS tokens_md5
FROM (SELECT doc_id, {tok_doc} AS tk FROM documents)""",
        "conversation_tokens": f"""
SELECT conv_id, turn, CAST(len(tk) AS BIGINT) AS n_tokens, md5(array_to_string(tk, chr(10))) AS tokens_md5
FROM (SELECT conv_id, turn, {sql_tokens(sql_ascii('text'))} AS tk FROM conversations)""",
        "token_counts": f"""
SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({tok_doc}) AS token FROM documents) GROUP BY token""",
        "token_shape": f"""
SELECT token,
  CAST(length(token) AS INT) AS length,
  CAST(regexp_matches(substr({abbrev}, 2), '[aeiouy]') AS INT) AS has_vowels,
  CAST(strpos(token, '.') > 0 AS INT) AS period,
  CAST(ends_with(token, ',') AS INT) AS comma,
  CAST(ends_with({clean}, '''s') AS INT) AS possessive,
  regexp_extract(token, '(0+)$', 1) AS trailing_zeros,
  CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'all_digits'
       WHEN regexp_matches(token, '[0-9]') THEN 'some_digits' ELSE 'no_digits' END AS digits,
  CASE WHEN regexp_matches(token, '^[^a-z]*[A-Z][^a-z]*$') THEN 'upper'
       WHEN regexp_matches(token, '^[^A-Z]*[a-z][^A-Z]*$') THEN 'lower'
       WHEN regexp_matches(token, '^[^A-Za-z]*[A-Z][a-z]*([^A-Za-z]+[A-Z][a-z]*)*[^A-Za-z]*$') THEN 'title'
       WHEN regexp_matches(token, '^[A-Za-z]+$') THEN 'mixed' ELSE 'false' END AS casing,
  {clean} AS token_clean,
  {abbrev} AS token_abbrev,
  CAST(strpos({clean}, '-') > 0 AS VARCHAR) AS hyphenated, CAST(strpos({clean}, '''') > 0 AS VARCHAR) AS contracted,
  CAST(regexp_matches({abbrev}, '^[A-Za-z]+$') AS VARCHAR) AS just_letters, CAST(regexp_matches({abbrev}, '^[A-Za-z]$') AS VARCHAR) AS initial,
  CAST(right({abbrev}, 1) IN ('a', 'e', 'i', 'o', 'u', 'y') AS VARCHAR) AS endswith_vowel,
  CAST(trim({abbrev}, 'xvi') = '' AS VARCHAR) AS roman, CAST(ends_with({clean}, '.') AS VARCHAR) AS abbrev,
  CASE WHEN regexp_matches({abbrev}, '^[0-9]+$') THEN 'd:' ELSE 'w:' END || length({abbrev}) AS "length_code",
  CAST(regexp_matches(token, '^(["''(]\\w+|\\w+[")''])') AND NOT regexp_matches(token, '^["''(]\\w+[")'']') AS VARCHAR) AS bracketed,
  CAST(regexp_matches(token, '^["''(]\\w+[")'']') AS VARCHAR) AS fullbracketed,
  CAST(length(regexp_replace({abbrev}, '[^aeiouy]', '', 'g')) > length(regexp_replace({abbrev}, '[aeiouy]', '', 'g')) AS VARCHAR) AS more_vowels,
  CASE WHEN regexp_matches(token, '^.+[^.\\w]') THEN right(token, 1) ELSE 'false' END AS endsinpunc,
  CASE WHEN regexp_matches({abbrev}, '^[0-9]+$') THEN 'false' ELSE {abbrev} END AS word
FROM (SELECT DISTINCT unnest({sql_tokens(sql_ascii('text'))}) AS token FROM documents)""",
        "gazetteer_flags": f"""
SELECT token,
  CAST(length(token) > 2 AND token IN ({loc}) AS INT) AS is_location,
  CAST(length(token) > 2 AND token IN ({obj}) AS INT) AS is_object,
  CAST({abbrev} IN ({prep}) AS INT) AS prepositions
FROM (SELECT DISTINCT unnest(tk) AS token FROM (
  SELECT {tok_doc} AS tk FROM documents
  UNION ALL SELECT {sql_tokens(sql_normalize('p_name'))} AS tk FROM part))""",
        "stopword_filter": f"""
WITH w AS (
  SELECT doc_id, CASE WHEN {nt} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({nt}, '\\s+') END AS w
  FROM documents
), k AS (
  SELECT doc_id, w, list_filter(w, lambda x: NOT list_contains({_stop_sql()}, x)) AS kept FROM w
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(kept) AS BIGINT) AS n_kept,
       md5(array_to_string(kept, ' ')) AS kept_md5 FROM k""",
        "ngrams_longest_first": _ngram_sql(),
        "token_pos": f"""
WITH pw AS (
  SELECT p_partkey, CASE WHEN {sql_normalize('p_name')} = '' THEN []::VARCHAR[]
                         ELSE regexp_split_to_array({sql_normalize('p_name')}, '\\s+') END AS w FROM part
),
lex AS (
  SELECT DISTINCT word, CASE WHEN i = len(w) - 1 THEN 'NN' ELSE 'JJ' END AS tag, p_partkey * 100 + i AS ord
  FROM (SELECT p_partkey, w, unnest(w) AS word, unnest(range(len(w))) AS i FROM pw)
),
lk AS (
  SELECT word, sum(CAST(tag LIKE 'NN%' AS INT)) AS nouns_count, sum(CAST(tag LIKE 'VB%' AS INT)) AS verbs_count,
         arg_max(tag, ord) AS nltk_tag FROM lex GROUP BY word
),
toks AS (
  SELECT DISTINCT unnest(tk) AS token FROM (
    SELECT {sql_tokens(nt)} AS tk FROM conversations
    UNION ALL SELECT {sql_tokens(sql_normalize('p_name'))} AS tk FROM part)
)
SELECT t.token, CAST(coalesce(lk.nouns_count, 0) AS INT) AS nouns_count,
       CAST(coalesce(lk.verbs_count, 0) AS INT) AS verbs_count, coalesce(lk.nltk_tag, '') AS nltk_tag
FROM toks t LEFT JOIN lk ON t.token = lk.word""",
    }
