"""Registered queries: every other reader and writer, over files that hold the driver tables' rows.

The files are written under ``spark.checkpoint.dir`` and read back with the
library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import clean as CL
from wordloom.operators import cluster as C
from wordloom.operators import features as FE
from wordloom.operators import labels as L
from wordloom.operators import sequence as SQ
from wordloom.operators import tokens as TK
from wordloom.plans import q_clean as QC
from wordloom.plans import q_labels as QL
from wordloom.plans.common import load, sql_normalize
from wordloom.session import stage_path
from wordloom.sources import readers as R
from wordloom.sources import sinks as K


def q_work_orders_file(spark, sf):
    """SRC-3: work orders from tab-separated files (address = customer, blanks for absent fields)."""
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = o.select(F.col("c_name").alias("address"), F.when(~urgent, F.col("o_orderpriority")).alias("category"),
                    F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string")).alias("description"), F.col("o_orderstatus").alias("unit"))
    path = stage_path(spark, "work-orders")
    rows.write.csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="")
    back = R.read_work_orders(spark, path)
    return back.groupBy(*R.WORK_ORDER_COLUMNS).agg(F.countDistinct("row_id").alias("n"))


def q_training_lines_file(spark, sf):
    """SRC-4 / SEQ-4: training lines from text files, how often each occurs and why it is rejected."""
    path = stage_path(spark, "lines")
    QL.training_lines(spark, sf).select("line").write.text(path)
    parsed = L.parse_training_lines(R.read_training_lines(spark, path), "line", "line_id")
    return parsed.groupBy(F.md5("line").alias("line_md5"), "reason").agg(F.countDistinct("line_id").alias("n"))


def q_synonyms_file(spark, sf):
    """SRC-5: phrases (part names) and targets (their brand, blanks as underscores) from tab-separated lines."""
    p = load(spark, sf, "part").select(F.concat_ws("\t", F.split("p_name", " "), F.concat(F.lit("Any_"), "p_brand")).alias("value"))
    path = stage_path(spark, "synonyms")
    p.write.text(path)
    back = R.read_synonyms(spark, path)
    return back.groupBy("phrase", "target").agg(F.countDistinct("file", "line_no").alias("n"))


def q_word_vectors_file(spark, sf):
    """SRC-7 / VEC-8: vectors from the text format of word vectors, brought to unit length."""
    e = load(spark, sf, "embeddings")
    path = stage_path(spark, "word-vectors")
    e.select(F.concat_ws(" ", F.concat(F.lit("w_"), F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    back = R.read_word_vectors(spark, path, "text")
    return back.select("term", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("vec_sum"))


def q_parse_log_file(spark, sf):
    """SNK-3: the parse log of every order sequence, line by line."""
    s = QL.order_sequences(spark, sf).withColumn("line", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    path = stage_path(spark, "parse-log")
    K.write_parse_log(s, "line", "tokens", "labels", path)
    return spark.read.text(path).select(F.md5("value").alias("line_md5"))


def q_entity_vectors_file(spark, sf):
    """SNK-4 / ORD-3: entity vectors written by type; two types read back from their folders."""
    e = load(spark, sf, "embeddings").select(F.concat(F.lit("type "), F.col("label").cast("string")).alias("type"),
                                             F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("entity"), F.col("embedding").alias("vec"))
    path = stage_path(spark, "entity-vectors")
    K.write_entity_vectors(e.where("type is not null"), path)
    back = spark.read.parquet(path).where(F.col("type").isin("type 1", "type 7"))
    return back.select("type", "entity", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("vec_sum"))


def q_cluster_report_file(spark, sf):
    """SNK-5: the report of clusters (part brand and size) of every type, line by line."""
    p = load(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_size").alias("cluster"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity"))
    path = stage_path(spark, "report")
    K.write_cluster_report(C.cluster_members(p), path)
    return spark.read.text(path).where("trim(value) <> ''").select("type", F.md5("value").alias("line_md5"))


def q_distinct_vector_records(spark, sf):
    """SRC-8 / SET-2: vector records that were written twice, read once each."""
    e = load(spark, sf, "embeddings")
    rows = e.select(F.concat(F.lit("t\te"), F.col("vec_id").cast("string"), F.lit("\t[ "), F.array_join(F.transform("embedding", lambda x: F.format_number(x.cast("double"), 6)), " "), F.lit("]")).alias("value"))
    path = stage_path(spark, "records")
    rows.unionByName(rows).write.text(path)
    back = R.read_entity_vectors_text(spark, path, distinct=True)
    return back.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))


def q_decode_bytes(spark, sf):
    """CLN-10: every document's bytes behind a malformed one, decoded."""
    d = load(spark, sf, "documents")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return d.select("doc_id", F.md5(T.decode_utf8(raw)).alias("text_md5"))


def q_gazetteer_table_flags(spark, sf):
    """JOIN-3 with a table: conversation tokens against words of part names (kind by the part's size)."""
    p = load(spark, sf, "part")
    kind = F.element_at(F.array(F.lit("location"), F.lit("object"), F.lit("preposition")), (F.col("p_size") % 3 + 1).cast("int"))
    c = load(spark, sf, "conversations").select(T.tokenize(T.normalize("text")).alias("tk"))
    tokens = TK.explode_with_pos(c, [], "tk", "_p", "token").select("token").distinct()
    mined = tokens.where(F.length("token") % 2 == 0).select(F.col("token").alias("term"), F.lit("object").alias("kind"))
    gazetteer = p.select(F.explode(F.split(T.normalize("p_name"), " ")).alias("term"), kind.alias("kind")).unionByName(mined)
    tokens = tokens.unionByName(gazetteer.select(F.col("term").alias("token"))).distinct()
    return FE.gazetteer_flags(tokens, "token", gazetteer).select("token", *[F.col(c).cast("int").alias(c) for c in ("is_location", "is_object", "prepositions")])


def q_last_wins_payload(spark, sf):
    """WIN-5: of every customer the latest order with its price and status."""
    o = load(spark, sf, "orders")
    return L.last_wins(o, "o_custkey", "o_orderkey", ["o_totalprice", "o_orderstatus"]).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


def q_preclean_turns(spark, sf):
    """CLN-6: conversation turns with phrases replaced, then spelling corrected."""
    c = load(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("sid"), T.normalize("text").alias("t"))
    r = CL.preclean(c, "sid", "t", CL.synonym_table(spark, QC.EXTRA_PHRASES), QC.dictionary(spark, sf), out="cleaned")
    return r.select("sid", F.md5("cleaned").alias("text_md5"))


def q_sequence_gradient(spark, sf):
    """SEQ-1: loss and gradient of the sequence model at zero weights, over the training lines (bias feature and transitions)."""
    train = SQ.training_sequences(QL.parsed_lines(spark, sf))
    objective = SQ.Objective(train)
    loss, grad = objective(SQ.np.zeros(objective.size))
    G, GA = objective.split(grad)
    names = objective.labels
    rows = [("loss", "", "", loss)] + [("bias", x, "", float(g)) for x, g in zip(names, G[objective.features.index("bias")])]
    rows += [("transition", a, b, float(GA[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "kind string, a string, b string, value double").withColumn("value", F.round("value", 4))


def q_kmeans_cluster_counts(spark, sf):
    """CLU-1 / CLU-2: points and clusters that k-means gives every type."""
    e = load(spark, sf, "embeddings").select(F.col("label").cast("string").alias("type"), F.col("vec_id").alias("entity"), F.col("embedding").alias("vec"))
    a = C.kmeans_by_type(e, "type", "entity", "vec")
    return a.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("n_clusters"))


QUERIES = {f.__name__[2:]: f for f in (
    q_work_orders_file, q_training_lines_file, q_synonyms_file, q_word_vectors_file, q_parse_log_file, q_entity_vectors_file, q_cluster_report_file,
    q_distinct_vector_records, q_decode_bytes, q_gazetteer_table_flags, q_last_wins_payload, q_preclean_turns, q_sequence_gradient, q_kmeans_cluster_counts)}


def sql() -> dict[str, str]:
    from wordloom.plans.common import sql_tokens
    labels = ", ".join(f"'{x}'" for x in fixed.MODEL_LABELS)
    n = len(fixed.MODEL_LABELS)
    words = QC._spell_words_sql(sql_normalize("text"))
    spelled = QC._SPELL.replace(f"{words} AS ws FROM documents", f"{QC._spell_words_sql('text')} AS ws FROM pre")
    return {
        "work_orders_file": """
SELECT coalesce(c_name, '') AS address, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS category,
       'order ' || o_orderkey AS description, o_orderstatus AS unit, count(*) AS n
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
        "training_lines_file": f"""WITH {QL._lines_sql()}
SELECT md5(line) AS line_md5, reason, count(*) AS n FROM lines JOIN judged ON lines.line_id = judged.line_id GROUP BY ALL""",
        "synonyms_file": """
SELECT lower(p_name) AS phrase, 'any ' || lower(p_brand) AS target, count(*) AS n FROM part GROUP BY ALL""",
        "word_vectors_file": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT 'w_' || vec_id AS term, CAST(len(v) AS INT) AS dim, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS vec_sum FROM v""",
        "parse_log_file": f"""WITH {QL._SEQ}
SELECT md5('order ' || okey || '--> [' || array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: '["' || tokens[i] || '","' || labels[i] || '"]'), ',') || ']') AS line_md5 FROM seq""",
        "entity_vectors_file": """
SELECT 'type ' || label AS type, 'e' || vec_id AS entity, round(list_sum(embedding::DOUBLE[]), 5) AS vec_sum FROM embeddings WHERE label IN (1, 7)""",
        "cluster_report_file": """
SELECT p_type AS type, md5('Cluster ' || p_size || ': [' || string_agg('part ' || p_partkey, ', ' ORDER BY 'part ' || p_partkey) || ']') AS line_md5
FROM part GROUP BY p_type, p_size HAVING count(*) > 1""",
        "distinct_vector_records": "SELECT 'e' || vec_id AS entity, count(*) AS n, CAST(max(len(embedding)) AS INT) AS dim FROM embeddings GROUP BY ALL",
        "decode_bytes": "SELECT doc_id, md5(chr(65533) || coalesce(text, '')) AS text_md5 FROM documents",
        "gazetteer_table_flags": f"""
WITH tokens AS (SELECT DISTINCT unnest({sql_tokens(sql_normalize("text"))}) AS token FROM conversations),
g AS (SELECT unnest(string_split({sql_normalize("p_name")}, ' ')) AS term, ['location', 'object', 'preposition'][p_size % 3 + 1] AS kind FROM part
      UNION ALL SELECT token, 'object' FROM tokens WHERE length(token) % 2 = 0),
t AS (SELECT token, CASE WHEN token = '&' THEN token ELSE regexp_replace(regexp_replace(lower(token), '^\\W*|[^.\\w]*$', '', 'g'), '\\W', '', 'g') END AS abbr
      FROM (SELECT token FROM tokens UNION SELECT term FROM g))
SELECT token, CAST(length(token) > 2 AND token IN (SELECT term FROM g WHERE kind = 'location') AS INT) AS is_location,
       CAST(length(token) > 2 AND token IN (SELECT term FROM g WHERE kind = 'object') AS INT) AS is_object,
       CAST(abbr IN (SELECT term FROM g WHERE kind = 'preposition') AS INT) AS prepositions FROM t""",
        "last_wins_payload": """
SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
FROM orders GROUP BY o_custkey""",
        "preclean_turns": f"""
WITH pre AS (SELECT doc_id, c AS text FROM ({QC._synonym_sql().replace("FROM documents", "FROM (SELECT conv_id || '_' || turn AS doc_id, text FROM conversations)").replace("CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS text_md5", "c")})),
{spelled},
per AS (SELECT w.doc_id, string_agg(coalesce(b.correction, w.word), ' ' ORDER BY w.pos) AS c FROM dwords w LEFT JOIN best b ON w.word = b.word GROUP BY w.doc_id)
SELECT pre.doc_id AS sid, md5(coalesce(per.c, '')) AS text_md5 FROM pre LEFT JOIN per ON pre.doc_id = per.doc_id""",
        "sequence_gradient": f"""WITH {QL._lines_sql()},
toks AS (SELECT line_id, pos, label, unnest(range(len(tk))) AS i FROM (SELECT *, {sql_tokens("term")} AS tk FROM pairs)),
seqs AS (SELECT line_id, label, row_number() OVER w AS p, lead(label) OVER w AS nxt FROM toks WINDOW w AS (PARTITION BY line_id ORDER BY pos, i)),
names AS (SELECT unnest([{labels}]) AS x),
k AS (SELECT count(*) AS tokens, count(nxt) AS pairs FROM seqs)
SELECT 'loss' AS kind, '' AS a, '' AS b, round(tokens * ln({n}), 4) AS value FROM k
UNION ALL SELECT 'bias', x, '', round(tokens / {n} - (SELECT count(*) FROM seqs WHERE label = x), 4) FROM names, k
UNION ALL SELECT 'transition', u.x, v.x, round(pairs / {n * n} - (SELECT count(*) FROM seqs WHERE label = u.x AND nxt = v.x), 4) FROM names u, names v, k""",
        "kmeans_cluster_counts": """
SELECT CAST(label AS VARCHAR) AS type, count(*) AS n, least(greatest(count(*) // 5, 1), count(DISTINCT embedding)) AS n_clusters FROM embeddings GROUP BY label""",
    }
