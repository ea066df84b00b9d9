"""Registered queries: token features, Viterbi decoding, model fitting and dataset labelling.

Training lines are the ones derived from orders and parts (see
``q_labels``); the silver-labelled order sequences are the evaluation set;
the documents play the work orders to be labelled.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import features as FE
from wordloom.operators import labels as L
from wordloom.operators import sequence as SQ
from wordloom.plans import q_labels as QL
from wordloom.plans.common import load

# Parameter of the queries: a small POS lexicon over the words of the order and conversation texts (word, tag, order).
LEXICON = [("fix", "VB", 0), ("fix", "NN", 1), ("the", "DT", 0), ("of", "IN", 0), ("and", "CC", 0), ("is", "VBZ", 0), ("thing", "NN", 0),
           ("almond", "NN", 0), ("antique", "JJ", 0), ("steel", "NN", 0), ("steel", "VB", 1), ("brass", "NN", 0), ("green", "JJ", 0),
           ("polished", "VBN", 0), ("a", "DT", 0), ("to", "TO", 0), ("for", "IN", 0), ("with", "IN", 0), ("that", "WDT", 0), ("on", "IN", 0)]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, tag string, ord int")


def q_token_features(spark, sf):
    """FEA-10..12: every token of every conversation turn with its own and its neighbours' features."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", T.tokenize(T.normalize("text")).alias("tokens"))
    c = FE.with_pos_array(c, "tokens", lexicon(spark))
    f = c.select("conv_id", "turn", FE.sequence_features("tokens", "pos").alias("features"))
    e = FE.explode_features(f, ["conv_id", "turn"], "features")
    return e.select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), "token",
                    F.col("feat.nouns_count").alias("nouns_count"), F.col("feat.verbs_count").alias("verbs_count"),
                    F.col("feat.nltk_tag").alias("nltk_tag"), F.col("feat.period").cast("int").alias("period"),
                    F.col("feat.comma").cast("int").alias("comma"), F.col("feat.possessive").cast("int").alias("possessive"),
                    F.col("feat.length").alias("length"), F.col("feat.is_location").cast("int").alias("is_location"),
                    F.col("feat.is_object").cast("int").alias("is_object"),
                    F.col("feat.has_vowels").cast("int").alias("has_vowels"),
                    F.col("feat.prepositions").cast("int").alias("prepositions"),
                    F.col("rawstring_start").cast("int").alias("rawstring_start"),
                    F.col("rawstring_end").cast("int").alias("rawstring_end"),
                    F.col("singleton").cast("int").alias("singleton"),
                    F.col("previous.f.length").alias("prev_length"),
                    F.col("previous.rawstring_start").cast("int").alias("prev_start"),
                    F.col("next.f.length").alias("next_length"),
                    F.col("next.rawstring_end").cast("int").alias("next_end"))


# A small hand-set model: objects after descriptions, gazetteer words by kind; and its transitions.
FIXED_WEIGHTS = [("bias", "noise", 0.5), ("is_object", "object", 2.0), ("is_location", "location", 2.0),
                 ("rawstring.end", "object", 1.5), ("next:rawstring.end", "description", 1.0),
                 ("prepositions", "conjunction", 1.5), ("length", "description", 0.125), ("nltk_tag:JJ", "description", 0.75)]
FIXED_TRANSITIONS = [("description", "object", 1.0), ("object", "object", 0.5)]


def fixed_model() -> SQ.SequenceModel:
    m = SQ.SequenceModel(features=sorted({w[0] for w in FIXED_WEIGHTS}))
    pos = {l: i for i, l in enumerate(m.labels)}
    for name, label, w in FIXED_WEIGHTS:
        m.W[m.features.index(name), pos[label]] += w
    for a, b, w in FIXED_TRANSITIONS:
        m.A[pos[a], pos[b]] = w
    return m


def q_viterbi_decode(spark, sf):
    """SEQ-2: best label path of every order sequence under a fixed model."""
    s = QL.order_sequences(spark, sf).select("o_orderkey", "tokens")
    model = fixed_model()
    d = SQ.decode(s, model, "tokens", lexicon(spark))
    return d.select("o_orderkey", F.array_join("labels", " ").alias("labels"))


def fitted_model(spark, sf, history=None):
    train = SQ.training_sequences(QL.parsed_lines(spark, sf))
    return SQ.fit(train, lexicon=lexicon(spark), history=history)


def q_fit_sequence_model(spark, sf):
    """SEQ-1: fit on the training lines, report per-label accuracy on the silver order sequences."""
    model = fitted_model(spark, sf)
    s = QL.order_sequences(spark, sf)
    d = SQ.decode(s, model, "tokens", lexicon(spark), out="pred", batched=True)
    z = d.select(F.explode(F.arrays_zip(F.col("labels").alias("gold"), F.col("pred").alias("pred"))).alias("z"))
    return z.groupBy(F.col("z.gold").alias("label")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum((F.col("z.gold") == F.col("z.pred")).cast("int")).alias("n_correct"))


def q_label_dataset(spark, sf):
    """SEQ-3: label every document (as a work order) and pivot the labels to entity columns."""
    model = fitted_model(spark, sf)
    d = load(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("address"), F.col("lang").alias("category"),
        T.normalize("text").alias("description"), F.lit("").alias("unit"))
    # a file may have few row groups, and labelling is all the work
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lab = SQ.label_tokens(d, "description", model, lexicon(spark))
    cols = L.with_label_columns(lab, "tokens", "labels")
    out = [F.md5(F.col("ent_description" if c == "description" else c)).alias(c)
           for c in fixed.LABELS + [fixed.OBJECT2]]
    return cols.select("doc_id", "address", "category", *out)


def q_label_turns(spark, sf):
    """SEQ-3 under the fixed model: every conversation turn labelled and pivoted to entity columns."""
    d = load(spark, sf, "conversations").select("conv_id", "turn", T.normalize("text").alias("description"))
    cols = L.with_label_columns(SQ.label_tokens(d, "description", fixed_model(), lexicon(spark)), "tokens", "labels", keep=["conv_id", "turn"])
    return cols.select("conv_id", "turn", *[F.md5(F.col(c)).alias(c) for c in fixed.LABELS + [fixed.OBJECT2]])


QUERIES = {
    "label_turns": q_label_turns,
    "token_features": q_token_features,
    "viterbi_decode": q_viterbi_decode,
    "fit_sequence_model": q_fit_sequence_model,
    "label_dataset": q_label_dataset,
}


def sql() -> dict[str, str]:
    from wordloom.plans.common import sql_normalize, sql_tokens
    loc = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(fixed.LOCATIONS))
    obj = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(fixed.OBJECTS))
    prep = ", ".join("'" + w + "'" for w in fixed.PREPOSITIONS)
    clean = ("CASE WHEN token = '&' THEN token ELSE "
             "regexp_replace(lower(token), '^\\W*|[^.\\w]*$', '', 'g') END")
    abbrev = f"CASE WHEN token = '&' THEN token ELSE regexp_replace({clean}, '\\W', '', 'g') END"
    lex = ", ".join(f"('{w}', '{t}', {o})" for w, t, o in LEXICON)
    return {
        "viterbi_decode": f"""{_viterbi_sql(clean, abbrev, loc, obj, prep, lex, QL._SEQ + ", seqs AS (SELECT okey AS o_orderkey, tokens FROM seq)")}
SELECT o_orderkey, array_to_string(labels, ' ') AS labels FROM best UNION ALL SELECT o_orderkey, '' FROM seqs WHERE len(tokens) = 0""",
        "label_turns": _label_turns_sql(_viterbi_sql(clean, abbrev, loc, obj, prep, lex, "seqs AS (SELECT {'c': conv_id, 't': turn} AS o_orderkey, "
                                                     + sql_tokens(sql_normalize("text")) + " AS tokens FROM conversations)")),
        "token_features": f"""
WITH lex(word, tag, ord) AS (VALUES {lex}),
s AS (SELECT conv_id, turn, {sql_tokens(sql_normalize('text'))} AS tk FROM conversations),
t AS (SELECT conv_id, turn, len(tk) AS n, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM s),
f AS (
  SELECT conv_id, turn, n, pos, token, CAST(length(token) AS INT) AS length,
    CAST(length(token) > 2 AND token IN ({loc}) AS INT) AS is_location,
    CAST(length(token) > 2 AND token IN ({obj}) AS INT) AS is_object,
    CAST(regexp_matches(substr({abbrev}, 2), '[aeiouy]') AS INT) AS has_vowels,
    CAST({abbrev} IN ({prep}) AS INT) AS prepositions,
    CAST(pos = 0 AND n > 1 AS INT) AS rawstring_start,
    CAST(pos = n - 1 AND n > 1 AS INT) AS rawstring_end,
    CAST(n = 1 AS INT) AS singleton,
    CAST(contains(token, '.') AS INT) AS period, CAST(token LIKE '%,' AS INT) AS comma, CAST({clean} LIKE '%''s' AS INT) AS possessive,
    CAST(coalesce((SELECT count(*) FROM lex WHERE word = token AND tag LIKE 'NN%'), 0) AS INT) AS nouns_count,
    CAST(coalesce((SELECT count(*) FROM lex WHERE word = token AND tag LIKE 'VB%'), 0) AS INT) AS verbs_count,
    coalesce((SELECT max_by(tag, ord) FROM lex WHERE word = token), '') AS nltk_tag
  FROM t
)
SELECT conv_id, turn, CAST(pos AS INT) AS pos, token, nouns_count, verbs_count, nltk_tag, period, comma, possessive, length, is_location, is_object, has_vowels, prepositions,
  rawstring_start, rawstring_end, singleton,
  lag(length) OVER w AS prev_length, lag(rawstring_start) OVER w AS prev_start,
  lead(length) OVER w AS next_length, lead(rawstring_end) OVER w AS next_end
FROM f WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)""",
    }


def _label_turns_sql(decoded: str) -> str:
    columns = fixed.LABELS + [fixed.OBJECT2]
    runs = QL._RUNS[len(QL._SEQ):].replace("{cols}", ", ".join(f"coalesce(string_agg(CASE WHEN label = '{c}' THEN term END, ' ' ORDER BY pos), '') AS \"{c}\"" for c in columns))
    return f"""{decoded},
tok AS (SELECT okey, i - 1 AS pos, tokens[i] AS token, labels[i] AS label FROM (
  SELECT seqs.o_orderkey AS okey, tokens, labels, unnest(range(1, len(tokens) + 1)) AS i FROM seqs JOIN best ON seqs.o_orderkey = best.o_orderkey))
{runs}
SELECT seqs.o_orderkey.c AS conv_id, seqs.o_orderkey.t AS turn, {", ".join(f"md5(coalesce(cols.{c}, '')) AS {c}" for c in columns)}
FROM seqs LEFT JOIN cols ON cols.o_orderkey = seqs.o_orderkey"""


def _viterbi_sql(clean: str, abbrev: str, loc: str, obj: str, prep: str, lex: str, seqs: str) -> str:
    """best(o_orderkey, labels) of the sequences ``seqs`` as a recursive query over positions: the best score of each label and the label before it."""
    number = {x: i for i, x in enumerate(fixed.MODEL_LABELS)}
    value = {"bias": "1.0", "is_object": f"CAST(length(token) > 2 AND token IN ({obj}) AS DOUBLE)",
             "is_location": f"CAST(length(token) > 2 AND token IN ({loc}) AS DOUBLE)", "rawstring.end": "CAST(pos = n - 1 AND n > 1 AS DOUBLE)",
             "next:rawstring.end": "CAST(pos = n - 2 AND n > 1 AS DOUBLE)", "prepositions": f"CAST({abbrev} IN ({prep}) AS DOUBLE)",
             "length": "CAST(length(token) AS DOUBLE)",
             "nltk_tag:JJ": "CAST(coalesce((SELECT max_by(tag, ord) FROM lex WHERE word = token), '') = 'JJ' AS DOUBLE)"}
    score = {x: " + ".join(f"{w} * ({value[f]})" for f, label, w in FIXED_WEIGHTS if label == x) or "0.0" for x in number}
    emit = " UNION ALL ".join(f"SELECT o_orderkey, pos, n, {i} AS l, {score[x]} AS e FROM t" for x, i in number.items())
    moves = ", ".join(f"({number[a]}, {number[b]}, {w})" for a, b, w in FIXED_TRANSITIONS)
    names = ", ".join(f"'{x}'" for x in fixed.MODEL_LABELS)
    return f"""
WITH RECURSIVE lex(word, tag, ord) AS (VALUES {lex}), {seqs},
t AS (SELECT o_orderkey, len(tokens) AS n, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM seqs),
e AS ({emit}),
a(p, l, w) AS (VALUES {moves}),
-- score list by label, and the paths so far by label; ties to the smaller label
em AS (SELECT o_orderkey, pos, n, list(e ORDER BY l) AS es FROM e GROUP BY ALL),
trans AS (SELECT list(row_w ORDER BY l) AS m FROM (
  SELECT l, list(coalesce(w, 0.0) ORDER BY p) AS row_w FROM (
    SELECT p.i AS p, l.i AS l, a.w FROM range({len(number)}) p(i) CROSS JOIN range({len(number)}) l(i) LEFT JOIN a ON a.p = p.i AND a.l = l.i) GROUP BY l)),
v AS (
  SELECT o_orderkey, pos, n, es AS s, list_transform(range({len(number)}), lambda i: [i]) AS paths FROM em WHERE pos = 0
  UNION ALL
  SELECT v.o_orderkey, em.pos, v.n,
    list_transform(range({len(number)}), lambda j: em.es[j + 1] + list_max(list_transform(range({len(number)}), lambda i: v.s[i + 1] + trans.m[j + 1][i + 1]))),
    list_transform(range({len(number)}), lambda j: list_append(v.paths[list_position(
      list_transform(range({len(number)}), lambda i: v.s[i + 1] + trans.m[j + 1][i + 1]),
      list_max(list_transform(range({len(number)}), lambda i: v.s[i + 1] + trans.m[j + 1][i + 1])))], j))
  FROM v JOIN em ON em.o_orderkey = v.o_orderkey AND em.pos = v.pos + 1, trans
),
best AS (SELECT o_orderkey, list_transform(paths[list_position(s, list_max(s))], lambda i: [{names}][i + 1]) AS labels FROM v WHERE pos = n - 1)"""
