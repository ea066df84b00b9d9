"""Registered queries: word vectors, IDF weights, means, outliers, segmentation, resolution.

There is no pre-trained word-vector table among the driver tables, so one is
derived from ``embeddings``: a term's vector is the embedding whose
``vec_id`` equals ``md5-bucket(term) mod 2N`` (N = number of embeddings).
Half of the buckets have no embedding, so about half of all terms are
unknown - the lookups, fall-backs and defaults all get exercised, and the
rule is a pure function of the term, so the oracle computes the same table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import tokens as TK
from wordloom.operators import vectors as V
from wordloom.plans.common import load, sql_normalize
from wordloom.session import checked_broadcast, stage_path

# Numbers of vectors, 8 bytes each, that are broadcast to tell which terms have one.
NUMBERS = 5_000_000


def derived_vectors(spark, sf, terms):
    """``(term, vec_id, vec)`` for the distinct candidate ``terms`` that have a vector."""
    emb = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = emb.count()
    t = terms.select("term").distinct().withColumn("vec_id", V.vector_bucket("term", 2 * n))
    return t.join(emb, "vec_id").select("term", "vec_id", "vec")


def derived_numbers(spark, sf, terms):
    """``(term, vec_id)`` for the distinct candidate ``terms`` that have a vector, stored, and ``(vec_id, vec)``: many terms share a vector."""
    emb = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    t = terms.select("term").distinct().withColumn("vec_id", V.vector_bucket("term", 2 * emb.count()))
    path = stage_path(spark, "term_numbers")
    t.join(checked_broadcast(emb.select("vec_id").distinct(), max_rows=NUMBERS), "vec_id", "left_semi").write.parquet(path)
    return spark.read.parquet(path), emb


def turns(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", T.normalize("text").alias("t"))


def turn_words(spark, sf):
    return TK.explode_with_pos(turns(spark, sf), ["conv_id", "turn", "role"], T.space_split("t"), "pos", "word")


def _r6(c):
    return F.round(c, 6)


def q_vector_norm(spark, sf):
    """VEC-7 / VEC-8 on every embedding."""
    e = load(spark, sf, "embeddings")
    u = V.normalized("embedding")
    return e.select("vec_id", _r6(V.l2_norm("embedding")).alias("norm"),
                    _r6(F.aggregate(u, F.lit(0.0), lambda a, x: a + x)).alias("unit_sum"))


def q_vector_lookup(spark, sf):
    """JOIN-1: every distinct conversation word, found or not."""
    w = turn_words(spark, sf).select(F.col("word").alias("term")).distinct()
    vt = derived_vectors(spark, sf, w)
    j = V.lookup_vectors(w, "term", vt.select("term", "vec"))
    return j.select("term", F.col("vec").isNotNull().cast("int").alias("found"),
                    _r6(V.l2_norm("vec")).alias("norm"))


def q_mean_vector(spark, sf):
    """AGG-7: mean vector of the known words of each conversation turn."""
    w = turn_words(spark, sf)
    vt = derived_vectors(spark, sf, w.select(F.col("word").alias("term")))
    j = V.lookup_vectors(w, "word", vt.select("term", "vec"))
    m = V.mean_vectors(j, ["conv_id", "turn"], "vec")
    return m.select("conv_id", "turn", F.col("n_found").cast("bigint").alias("n_found"),
                    _r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
                    _r6(F.get("vec", 0)).alias("vec_first"))


def turn_idf(spark, sf):
    return V.idf_by_type(turns(spark, sf), "role", "t")


def q_weighted_mean(spark, sf):
    """VEC-4 + JOIN-6: IDF-weighted mean (type = role)."""
    w = turn_words(spark, sf)
    vt = derived_vectors(spark, sf, w.select(F.col("word").alias("term")))
    j = V.with_weights(w, "role", "word", turn_idf(spark, sf))  # before the vectors, which are wide
    j = V.lookup_vectors(j, "word", vt.select("term", "vec"))
    m = V.mean_vectors(j, ["conv_id", "turn"], "vec", weight_col="weight")
    return m.select("conv_id", "turn", F.col("n_found").cast("bigint").alias("n_found"),
                    _r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"))


def q_idf_ngrams(spark, sf):
    """AGG-4 / AGG-5: smoothed IDF of every 1-4-gram per conversation role."""
    i = turn_idf(spark, sf)
    return i.select("type", "gram", F.col("df").cast("bigint").alias("df"),
                    F.col("n_docs").cast("bigint").alias("n_docs"), _r6(F.col("idf")).alias("idf"))


def q_idf_max(spark, sf):
    """AGG-6."""
    return V.max_idf(turn_idf(spark, sf)).select("type", _r6(F.col("max_idf")).alias("max_idf"))


def q_idf_weight_default(spark, sf):
    """JOIN-6: words looked up under the other role's weights (seen, unseen, unknown type)."""
    w = turn_words(spark, sf).select(
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "user")
         .otherwise("nobody").alias("type"), "word").distinct()
    out = V.with_weights(w, "type", "word", turn_idf(spark, sf))
    return out.select("type", "word", _r6(F.col("weight")).alias("weight"))


def q_outlier_word(spark, sf):
    """VEC-3: least similar known word of each turn."""
    t = turns(spark, sf)
    t = t.select(F.concat_ws("_", "conv_id", "turn").alias("sid"), "t")
    vt = derived_vectors(spark, sf, TK.explode_with_pos(t, [], T.space_split("t"), "_p", "term"))
    o = V.outlier_words(t, "sid", "t", vt.select("term", "vec"))
    return o.select("sid", "outlier", F.col("n_known").cast("bigint").alias("n_known"))


def q_entity_reduce(spark, sf):
    """VEC-2: one reduction step of each turn (outlier removed, else last word dropped)."""
    t = turns(spark, sf)
    t = t.select(F.concat_ws("_", "conv_id", "turn").alias("sid"), "t")
    vt = derived_vectors(spark, sf, TK.explode_with_pos(t, [], T.space_split("t"), "_p", "term"))
    r = V.reduce_entities(t, "sid", "t", vt.select("term", "vec"))
    return r.select("sid", F.md5("reduced").alias("reduced_md5"))


def _seg_input(spark, sf):
    t = turns(spark, sf).select(F.concat_ws("_", "conv_id", "turn").alias("sid"), "t")
    grams = TK.explode_ngrams(t.select("sid", T.space_split("t").alias("w")), "sid", "w")
    keys, vectors = derived_numbers(spark, sf, grams.select(T.vector_key("gram").alias("term")))
    return t, keys, vectors


def q_ngram_segment(spark, sf):
    """SEG-1: longest-known-n-gram cover of every whole conversation turn."""
    t, keys, vectors = _seg_input(spark, sf)
    s = V.segment(t, "sid", "t", vectors, keys=keys)
    return s.select("sid", F.col("n_grams").cast("bigint").alias("n_grams"),
                    F.md5(F.array_join("grams", "|")).alias("grams_md5"),
                    _r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"))


def q_resolve_entity(spark, sf):
    """VEC-1 / VEC-6 on part names (type = p_type, weights = IDF of part names per type)."""
    p = load(spark, sf, "part").select("p_partkey", "p_type", T.normalize("p_name").alias("entity"))
    grams = TK.explode_ngrams(p.select("p_partkey", T.space_split("entity").alias("w")), "p_partkey", "w")
    vt = derived_vectors(spark, sf, grams.select(T.vector_key("gram").alias("term")))
    idf = V.idf_by_type(p, "p_type", "entity")
    r = V.resolve_entities(p, vt.select("term", "vec"), idf, id_col="p_partkey", type_col="p_type",
                           text_col="entity")
    return r.select(F.col("id").alias("p_partkey"), "method",
                    _r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
                    _r6(F.get("vec", 0)).alias("vec_first"))


QUERIES = {
    "vector_norm": q_vector_norm,
    "vector_lookup": q_vector_lookup,
    "mean_vector": q_mean_vector,
    "weighted_mean": q_weighted_mean,
    "idf_ngrams": q_idf_ngrams,
    "idf_max": q_idf_max,
    "idf_weight_default": q_idf_weight_default,
    "outlier_word": q_outlier_word,
    "entity_reduce": q_entity_reduce,
    "ngram_segment": q_ngram_segment,
    "resolve_entity": q_resolve_entity,
}

# ---------------------------------------------------------------------------
# oracle SQL (DuckDB)
# ---------------------------------------------------------------------------

_BUCKET = "((('0x' || substr(md5({t}), 1, 8))::BIGINT) % (2 * (SELECT count(*) FROM embeddings)))"

_TURNS = f"""
t AS (SELECT conv_id, turn, role, {sql_normalize('text')} AS t FROM conversations),
w AS (
  SELECT conv_id, turn, role, word FROM (
    SELECT conv_id, turn, role, unnest(CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(t, '\\s+') END) AS word FROM t)
),
vt AS (
  SELECT v.term, e.vec_id, e.embedding::DOUBLE[] AS vec
  FROM (SELECT DISTINCT word AS term FROM w) v JOIN embeddings e ON e.vec_id = {_BUCKET.format(t='v.term')}
)"""

_IDF = """
dg AS (
  SELECT role AS type, list_distinct(flatten(list_transform(range(4, 0, -1), lambda n:
           list_transform(range(0, greatest(len(ws) - n + 1, 0)), lambda s: array_to_string(ws[s + 1:s + n], ' '))))) AS g
  FROM (SELECT role, regexp_extract_all(lower(t), '\\b\\w\\w+\\b', 0) AS ws FROM t)
),
nd AS (SELECT type, count(*) AS n_docs FROM dg GROUP BY type),
idf AS (
  SELECT d.type, d.gram, count(*) AS df, nd.n_docs, ln((1 + nd.n_docs) / (1 + count(*))) + 1 AS idf
  FROM (SELECT type, unnest(g) AS gram FROM dg) d JOIN nd ON d.type = nd.type
  GROUP BY d.type, d.gram, nd.n_docs
),
mx AS (SELECT type, max(idf) AS max_idf FROM idf GROUP BY type)"""


_OUTLIER = """
s AS (SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS sid, conv_id, turn FROM t),
u AS (
  SELECT term, list_transform(vec, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) AS u
  FROM (SELECT term, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM vt)
),
k AS (SELECT w.conv_id, w.turn, w.word, u.u FROM w JOIN u ON w.word = u.term),
comp AS (
  SELECT conv_id, turn, i, sum(u[i]) / count(*) AS m
  FROM (SELECT conv_id, turn, u, unnest(range(1, len(u) + 1)) AS i FROM k) GROUP BY conv_id, turn, i
),
mean AS (SELECT conv_id, turn, list(m ORDER BY i) AS m FROM comp GROUP BY conv_id, turn),
sim AS (
  SELECT k.conv_id, k.turn, k.word,
         round(list_sum(list_transform(range(1, len(k.u) + 1), lambda i: k.u[i] * mean.m[i])), 9) AS sim
  FROM k JOIN mean ON k.conv_id = mean.conv_id AND k.turn = mean.turn
),
best AS (SELECT conv_id, turn, arg_min(word, (sim, word)) AS outlier, count(*) AS n_known FROM sim GROUP BY conv_id, turn)"""


def _segment_sql() -> str:
    """Longest-first cover of every turn, folding one span after the other."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in TK.english_stopwords())
    return f"""
WITH t AS (
  SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS sid, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END AS ws
  FROM (SELECT conv_id, turn, {sql_normalize('text')} AS t FROM conversations)
),
span AS (
  SELECT sid, n, s, array_to_string(ws[s + 1:s + n], ' ') AS gram FROM (
    SELECT sid, ws, n, unnest(range(0, greatest(len(ws) - n + 1, 0))) AS s FROM t, (SELECT unnest([1, 2, 3, 4]) AS n))
),
vt AS (
  SELECT v.term, e.embedding::DOUBLE[] AS vec
  FROM (SELECT DISTINCT replace(gram, ' ', '_') AS term FROM span) v JOIN embeddings e ON e.vec_id = {_BUCKET.format(t='v.term')}
),
hit AS (
  SELECT sid, n, s, gram, row_number() OVER (PARTITION BY sid ORDER BY n DESC, s) AS i
  FROM span SEMI JOIN vt ON vt.term = replace(span.gram, ' ', '_') WHERE NOT (n = 1 AND gram IN ({stop}))
),
spans AS (
  SELECT sid, list(struct_pack(used := range(s, s + n), grams := [gram]) ORDER BY i) AS xs FROM hit GROUP BY sid
),
last AS (
  SELECT t.sid, coalesce(list_reduce(xs, lambda acc, x: CASE WHEN list_has_any(acc.used, x.used) THEN acc
    ELSE struct_pack(used := list_concat(acc.used, x.used), grams := list_concat(acc.grams, x.grams)) END).grams, []) AS grams
  FROM t LEFT JOIN spans ON t.sid = spans.sid
),
g AS (SELECT sid, unnest(list_distinct(grams)) AS gram FROM last),
comp AS (
  SELECT sid, i, avg(vec[i]) AS a FROM (
    SELECT g.sid, vt.vec, unnest(range(1, len(vt.vec) + 1)) AS i FROM g JOIN vt ON vt.term = replace(g.gram, ' ', '_')) GROUP BY sid, i
),
m AS (SELECT sid, round(sum(a), 6) AS vec_sum FROM comp GROUP BY sid)
SELECT last.sid, CAST(len(grams) AS BIGINT) AS n_grams, md5(array_to_string(grams, '|')) AS grams_md5, m.vec_sum
FROM last LEFT JOIN m ON last.sid = m.sid"""


def _vsum(v):
    return f"round(list_sum({v}), 6)"


def sql() -> dict[str, str]:
    return {
        "vector_norm": """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
       round(list_sum(list_transform(embedding::DOUBLE[], lambda x:
             CASE WHEN sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) > 0
                  THEN x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) ELSE 0 END)), 6) AS unit_sum
FROM embeddings""",
        "vector_lookup": f"""WITH {_TURNS}
SELECT d.term, CAST(vt.vec IS NOT NULL AS INT) AS found,
       round(sqrt(list_sum(list_transform(vt.vec, lambda x: x * x))), 6) AS norm
FROM (SELECT DISTINCT word AS term FROM w) d LEFT JOIN vt ON d.term = vt.term""",
        "mean_vector": f"""WITH {_TURNS},
j AS (SELECT w.conv_id, w.turn, vt.vec FROM w JOIN vt ON w.word = vt.term),
m AS (
  SELECT conv_id, turn, count(*) AS n_found,
         list_transform(range(1, 65), lambda i: avg(vec[i])) AS dummy
  FROM j GROUP BY conv_id, turn
),
comp AS (
  SELECT conv_id, turn, i, avg(vec[i]) AS a
  FROM (SELECT conv_id, turn, vec, unnest(range(1, len(vec) + 1)) AS i FROM j) GROUP BY conv_id, turn, i
)
SELECT c.conv_id, c.turn, CAST(n.n_found AS BIGINT) AS n_found,
       round(sum(a), 6) AS vec_sum, round(max(CASE WHEN i = 1 THEN a END), 6) AS vec_first
FROM comp c JOIN (SELECT conv_id, turn, count(*) AS n_found FROM j GROUP BY conv_id, turn) n
  ON c.conv_id = n.conv_id AND c.turn = n.turn
GROUP BY c.conv_id, c.turn, n.n_found""".replace("""m AS (
  SELECT conv_id, turn, count(*) AS n_found,
         list_transform(range(1, 65), lambda i: avg(vec[i])) AS dummy
  FROM j GROUP BY conv_id, turn
),
""", ""),
        "weighted_mean": f"""WITH {_TURNS}, {_IDF},
j AS (
  SELECT w.conv_id, w.turn, vt.vec, coalesce(idf.idf, mx.max_idf, 1.0) AS wt
  FROM w JOIN vt ON w.word = vt.term
  LEFT JOIN idf ON idf.type = w.role AND idf.gram = w.word
  LEFT JOIN mx ON mx.type = w.role
),
comp AS (
  SELECT conv_id, turn, i, avg(vec[i] * wt) AS a
  FROM (SELECT conv_id, turn, vec, wt, unnest(range(1, len(vec) + 1)) AS i FROM j) GROUP BY conv_id, turn, i
)
SELECT c.conv_id, c.turn, CAST(n.n_found AS BIGINT) AS n_found, round(sum(a), 6) AS vec_sum
FROM comp c JOIN (SELECT conv_id, turn, count(*) AS n_found FROM j GROUP BY conv_id, turn) n
  ON c.conv_id = n.conv_id AND c.turn = n.turn
GROUP BY c.conv_id, c.turn, n.n_found""",
        "idf_ngrams": f"""WITH {_TURNS}, {_IDF}
SELECT type, gram, CAST(df AS BIGINT) AS df, CAST(n_docs AS BIGINT) AS n_docs, round(idf, 6) AS idf FROM idf""",
        "idf_max": f"WITH {_TURNS}, {_IDF} SELECT type, round(max_idf, 6) AS max_idf FROM mx",
        "idf_weight_default": f"""WITH {_TURNS}, {_IDF},
q AS (SELECT DISTINCT CASE WHEN role = 'user' THEN 'assistant' WHEN role = 'assistant' THEN 'user'
                          ELSE 'nobody' END AS type, word FROM w)
SELECT q.type, q.word, round(coalesce(idf.idf, mx.max_idf, 1.0), 6) AS weight
FROM q LEFT JOIN idf ON idf.type = q.type AND idf.gram = q.word LEFT JOIN mx ON mx.type = q.type""",
        "outlier_word": f"""WITH {_TURNS}, {_OUTLIER}
SELECT s.sid, best.outlier, CAST(coalesce(best.n_known, 0) AS BIGINT) AS n_known
FROM s LEFT JOIN best ON s.conv_id = best.conv_id AND s.turn = best.turn""",
        "entity_reduce": f"""WITH {_TURNS}, {_OUTLIER},
r AS (
  SELECT s.sid, CASE WHEN t.t = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(t.t, '\\s+') END AS ws, best.outlier
  FROM s JOIN t ON s.conv_id = t.conv_id AND s.turn = t.turn LEFT JOIN best ON s.conv_id = best.conv_id AND s.turn = best.turn
)
SELECT sid, md5(array_to_string(CASE WHEN len(ws) <= 1 THEN ws
  WHEN outlier IS NOT NULL THEN list_concat(ws[1:list_position(ws, outlier) - 1], ws[list_position(ws, outlier) + 1:])
  ELSE ws[1:len(ws) - 1] END, ' ')) AS reduced_md5 FROM r""",
        "ngram_segment": _segment_sql(),
        "resolve_entity": f"""
WITH p AS (SELECT p_partkey, p_type, {sql_normalize('p_name')} AS entity FROM part),
pw AS (SELECT p_partkey, p_type, entity, string_split(entity, ' ') AS ws FROM p),
dg AS (
  SELECT p_type AS type, list_distinct(flatten(list_transform(range(4, 0, -1), lambda n:
           list_transform(range(0, greatest(len(ws) - n + 1, 0)), lambda s: array_to_string(ws[s + 1:s + n], ' '))))) AS g
  FROM (SELECT p_type, regexp_extract_all(lower(entity), '\\b\\w\\w+\\b', 0) AS ws FROM p)
),
nd AS (SELECT type, count(*) AS n_docs FROM dg GROUP BY type),
idf AS (
  SELECT d.type, d.gram, ln((1 + nd.n_docs) / (1 + count(*))) + 1 AS idf
  FROM (SELECT type, unnest(g) AS gram FROM dg) d JOIN nd ON d.type = nd.type GROUP BY d.type, d.gram, nd.n_docs
),
mx AS (SELECT type, max(idf) AS max_idf FROM idf GROUP BY type),
vt AS (
  SELECT v.term, e.embedding::DOUBLE[] AS vec FROM (
    SELECT DISTINCT replace(entity, ' ', '_') AS term FROM p
    UNION SELECT DISTINCT unnest(ws) AS term FROM pw) v
  JOIN embeddings e ON e.vec_id = {_BUCKET.format(t='v.term')}
),
direct AS (
  SELECT p.p_partkey, list_transform(vt.vec, lambda x: x * coalesce(idf.idf, mx.max_idf, 1.0)) AS vec
  FROM p JOIN vt ON vt.term = replace(p.entity, ' ', '_')
  LEFT JOIN idf ON idf.type = p.p_type AND idf.gram = p.entity LEFT JOIN mx ON mx.type = p.p_type
),
uni AS (
  SELECT pw.p_partkey, i, vt.vec FROM (SELECT p_partkey, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM pw) pw
  JOIN vt ON vt.term = pw.w
),
seg AS (
  SELECT p_partkey, list_transform(range(1, len(first(vec)) + 1), lambda k: 0) AS z, list(vec) AS vs FROM uni GROUP BY p_partkey
),
segm AS (
  SELECT p_partkey, list_transform(range(1, len(vs[1]) + 1), lambda k:
           list_sum(list_transform(vs, lambda v: v[k])) / len(vs)) AS vec FROM seg
),
res AS (
  SELECT p.p_partkey,
    CASE WHEN d.vec IS NOT NULL THEN 'direct' WHEN s.vec IS NOT NULL THEN 'segment' ELSE 'none' END AS method,
    coalesce(d.vec, s.vec) AS vec
  FROM p LEFT JOIN direct d ON p.p_partkey = d.p_partkey LEFT JOIN segm s ON p.p_partkey = s.p_partkey
)
SELECT p_partkey, method, round(list_sum(vec), 6) AS vec_sum, round(vec[1], 6) AS vec_first FROM res""",
    }
