"""Registered queries: training lines, label grouping and label <-> column reshapes.

Labelled text is derived from the order tables: every order becomes one
token sequence made of the names of its parts (line-number order).  The
last word of a part name is labelled ``object``, the words before it
``description``; a returned item (flag R) contributes its last word only,
which yields runs of consecutive objects.  Training lines are written from
the same sequences, with blank, misspelt and unknown labels taken from part
attributes, so every reject and backfill path is exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import labels as L
from wordloom.operators import tokens as TK
from wordloom.plans.common import load, sql_normalize

# ---------------------------------------------------------------------------
# derived inputs
# ---------------------------------------------------------------------------


def order_items(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    w = F.split(T.normalize("p_name"), " ")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "p_type", "p_brand", "p_size", w.alias("w"))


def order_sequences(spark, sf):
    """``(o_orderkey, tokens, labels)``: one silver-labelled sequence per order with items."""
    it = order_items(spark, sf)
    n = F.size("w")
    mods = F.slice("w", 1, n - 1)
    toks = F.when(F.col("l_returnflag") == "R", F.array(F.get("w", n - 1))) \
            .otherwise(F.concat(mods, F.array(F.get("w", n - 1))))
    labs = F.when(F.col("l_returnflag") == "R", F.array(F.lit("object"))) \
            .otherwise(F.concat(F.transform(mods, lambda x: F.lit("description")), F.array(F.lit("object"))))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag",
                                                 toks.alias("t"), labs.alias("l"))))
    return (it.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(items.alias("items"))
              .select("o_orderkey", F.flatten(F.transform("items", lambda x: x["t"])).alias("tokens"),
                      F.flatten(F.transform("items", lambda x: x["l"])).alias("labels")))


def training_lines(spark, sf):
    """``(line_id, line)``: one ragged ``term,label,...`` line per order (blank if no items)."""
    it = order_items(spark, sf)
    n = F.size("w")
    lab1 = (F.when(F.col("p_type") == "SMALL", F.lit(""))
             .when(F.col("p_brand") == "Brand#2", F.lit("anlysis"))
             .when(F.col("p_size") > 48, F.lit("colour"))
             .otherwise(F.lit("description")))
    cells = F.when(F.col("l_returnflag") == "R", F.array(F.get("w", n - 1), F.lit(""))) \
             .otherwise(F.concat(F.flatten(F.transform(F.slice("w", 1, n - 1), lambda x: F.array(x, lab1))),
                                 F.array(F.get("w", n - 1), F.lit("object"))))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", cells.alias("c"))))
    per = it.groupBy("l_orderkey").agg(F.array_join(F.flatten(F.transform(items, lambda x: x["c"])), ",").alias("body"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    line = F.concat(F.coalesce(F.col("body"), F.lit("")),
                    F.when(F.col("o_orderpriority") == "5-LOW", F.lit(",,")).otherwise(F.lit("")))
    return o.join(per, o.o_orderkey == per.l_orderkey, "left").select(
        F.col("o_orderkey").alias("line_id"), line.alias("line"))


def parsed_lines(spark, sf, mode="next"):
    return L.parse_training_lines(training_lines(spark, sf), "line", "line_id", mode=mode)


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------


def q_training_pairs(spark, sf):
    """RSH-3 + WIN-6 (next-label backfill) + CLN-9: accepted pairs in long form."""
    return L.training_pairs(parsed_lines(spark, sf)).select(
        "line_id", F.col("pos").cast("int").alias("pos"), "term", "label")


def q_training_backfill_last(spark, sf):
    """WIN-6 as coded originally: blanks take the line's last label."""
    return L.training_pairs(parsed_lines(spark, sf, "last")).select(
        "line_id", F.col("pos").cast("int").alias("pos"), "term", "label")


def q_training_rejects(spark, sf):
    """RSH-4: rejected lines and why."""
    return L.training_rejects(parsed_lines(spark, sf)).select("line_id", "reason")


def q_training_xml(spark, sf):
    """SNK-1 body per accepted line (digest)."""
    p = L.keep_rows(parsed_lines(spark, sf), F.col("reason").isNull())
    return p.select("line_id", F.md5(L.training_xml(p)).alias("xml_md5"))


def q_gazetteer_mine(spark, sf):
    """AGG-2: distinct terms per label with counts."""
    return L.gazetteer_mine(L.training_pairs(parsed_lines(spark, sf))).select(
        "label", "term", F.col("n").cast("bigint").alias("n"))


def q_label_vocab(spark, sf):
    """AGG-3: labels seen in accepted lines."""
    return L.label_vocabulary(L.training_pairs(parsed_lines(spark, sf))).select(
        "label", F.col("n_terms").cast("bigint").alias("n_terms"),
        F.col("n_lines").cast("bigint").alias("n_lines"))


def q_tag_group(spark, sf):
    """AGG-1: per order, tokens grouped by label in first-appearance order."""
    s = order_sequences(spark, sf)
    g = TK.explode_with_pos(s, "o_orderkey", L.group_tags("tokens", "labels"), "_p", "g")
    return g.select("o_orderkey", "g.label", F.col("g.first_pos").cast("int").alias("first_pos"), "g.text")


def q_merge_runs(spark, sf):
    """WIN-2: consecutive object tokens merged into one term."""
    s = order_sequences(spark, sf)
    r = TK.explode_with_pos(s, "o_orderkey", L.merge_object_runs("tokens", "labels"), "_p", "r")
    return r.select("o_orderkey", F.col("r.pos").cast("int").alias("pos"), "r.label", "r.term")


def labelled_columns(spark, sf):
    return L.with_label_columns(order_sequences(spark, sf), "tokens", "labels")


def q_labels_to_columns(spark, sf):
    """RSH-1 with WIN-3: one column per label plus object2."""
    return labelled_columns(spark, sf)


def q_columns_to_entities(spark, sf):
    """RSH-2: the entity columns melted to (type, entity)."""
    e = L.columns_to_entities(labelled_columns(spark, sf), "o_orderkey")
    return e.select("o_orderkey", "type", "entity")


def q_first_seen_dedupe(spark, sf):
    """WIN-4: each entity text once, from its first order, first type."""
    e = L.columns_to_entities(labelled_columns(spark, sf), "o_orderkey")
    d = L.first_seen(e, "entity", ["o_orderkey", "type_ord"], ["type"])
    return d.select("entity", "o_orderkey", "type")


def q_last_wins(spark, sf):
    """WIN-5: per (type, entity) the values of the latest order."""
    e = L.columns_to_entities(labelled_columns(spark, sf), "o_orderkey")
    return L.last_wins(e, ["type", "entity"], "o_orderkey").select("type", "entity", "o_orderkey")


QUERIES = {
    "training_pairs": q_training_pairs,
    "training_backfill_last": q_training_backfill_last,
    "training_rejects": q_training_rejects,
    "training_xml": q_training_xml,
    "gazetteer_mine": q_gazetteer_mine,
    "label_vocab": q_label_vocab,
    "tag_group": q_tag_group,
    "merge_runs": q_merge_runs,
    "labels_to_columns": q_labels_to_columns,
    "columns_to_entities": q_columns_to_entities,
    "first_seen_dedupe": q_first_seen_dedupe,
    "last_wins": q_last_wins,
}

# ---------------------------------------------------------------------------
# oracle SQL (DuckDB)
# ---------------------------------------------------------------------------

_ITEMS = f"""
it AS (
  SELECT l.l_orderkey AS okey, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_returnflag AS rf,
         p.p_type, p.p_brand, p.p_size, string_split({sql_normalize('p.p_name')}, ' ') AS w
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""

_SEQ = _ITEMS + """,
seq AS (
  SELECT okey,
    flatten(list(CASE WHEN rf = 'R' THEN [w[len(w)]] ELSE list_concat(w[1:len(w)-1], [w[len(w)]]) END
                 ORDER BY ln, pk, rf)) AS tokens,
    flatten(list(CASE WHEN rf = 'R' THEN ['object']
                      ELSE list_concat(list_transform(w[1:len(w)-1], lambda x: 'description'), ['object']) END
                 ORDER BY ln, pk, rf)) AS labels
  FROM it GROUP BY okey
),
tok AS (
  SELECT okey, i - 1 AS pos, tokens[i] AS token, labels[i] AS label
  FROM (SELECT okey, tokens, labels, unnest(range(1, len(tokens) + 1)) AS i FROM seq)
)"""

_RUNS = _SEQ + """,
st AS (
  SELECT *, CASE WHEN label = 'object' AND lag(label) OVER w = 'object' THEN 0 ELSE 1 END AS is_start
  FROM tok WINDOW w AS (PARTITION BY okey ORDER BY pos)
),
rn AS (SELECT *, sum(is_start) OVER (PARTITION BY okey ORDER BY pos) AS run FROM st),
runs AS (
  SELECT okey, run, min(pos) AS pos, string_agg(token, ' ' ORDER BY pos) AS term, first(label ORDER BY pos) AS label
  FROM rn GROUP BY okey, run
),
runs2 AS (
  SELECT okey, pos, term,
    CASE WHEN label = 'object' AND pos > min(CASE WHEN label = 'object' THEN pos END) OVER (PARTITION BY okey)
         THEN 'object2' ELSE replace(replace(label, 'decription', 'description'), 'inspect', 'action') END AS label
  FROM runs
),
cols AS (
  SELECT okey AS o_orderkey,
    {cols}
  FROM runs2 GROUP BY okey
)"""


def _cols_sql():
    parts = []
    for c in fixed.LABELS + [fixed.OBJECT2]:
        parts.append(f"coalesce(string_agg(CASE WHEN label = '{c}' THEN term END, ' ' ORDER BY pos), '') AS \"{c}\"")
    return _RUNS.replace("{cols}", ",\n    ".join(parts))


_LINES = _ITEMS + """,
cells AS (
  SELECT okey, ln, pk, rf,
    CASE WHEN rf = 'R' THEN [w[len(w)], '']
         ELSE list_concat(flatten(list_transform(w[1:len(w)-1], lambda x: [x,
                CASE WHEN p_type = 'SMALL' THEN '' WHEN p_brand = 'Brand#2' THEN 'anlysis'
                     WHEN p_size > 48 THEN 'colour' ELSE 'description' END])), [w[len(w)], 'object']) END AS c
  FROM it
),
per AS (SELECT okey, array_to_string(flatten(list(c ORDER BY ln, pk, rf)), ',') AS body FROM cells GROUP BY okey),
lines AS (
  SELECT o.o_orderkey AS line_id,
         coalesce(per.body, '') || CASE WHEN o.o_orderpriority = '5-LOW' THEN ',,' ELSE '' END AS line
  FROM orders o LEFT JOIN per ON o.o_orderkey = per.okey
),
f AS (SELECT line_id, line, string_split(replace(lower(line), 'anlysis', 'analysis'), ',') AS f FROM lines),
raw AS (
  SELECT line_id, line, i AS pos, f[2 * i + 1] AS term, coalesce(f[2 * i + 2], '') AS label
  FROM (SELECT line_id, line, f, unnest(range(0, (len(f) + 1) // 2)) AS i FROM f)
),
filled AS (
  SELECT *,
    CASE WHEN label <> '' THEN label ELSE {fill} END AS flabel
  FROM raw
),
per_line AS (
  SELECT l.line_id, l.line,
    (SELECT count(*) FROM filled x WHERE x.line_id = l.line_id AND x.term <> '') AS n_kept,
    (SELECT count(*) FROM filled x WHERE x.line_id = l.line_id AND x.label <> ''
        AND x.label NOT IN ({dom})) AS n_bad,
    (SELECT count(*) FROM filled x WHERE x.line_id = l.line_id AND x.term <> '' AND x.flabel IS NULL) AS n_unl
  FROM lines l
),
judged AS (
  SELECT line_id,
    CASE WHEN trim(line) = '' OR n_kept = 0 THEN 'blank_line'
         WHEN n_bad > 0 THEN 'bad_label'
         WHEN n_unl > 0 THEN 'unlabelled_term' END AS reason
  FROM per_line
),
pairs AS (
  SELECT f.line_id, CAST(f.pos AS INT) AS pos, f.term, f.flabel AS label
  FROM filled f JOIN judged j ON f.line_id = j.line_id
  WHERE j.reason IS NULL AND f.term <> ''
)"""

_FILL_NEXT = ("first_value(nullif(label, '') IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos "
              "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_FILL_LAST = ("last_value(nullif(label, '') IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


def _lines_sql(mode="next"):
    dom = ", ".join(f"'{x}'" for x in fixed.LABELS)
    return _LINES.replace("{fill}", _FILL_NEXT if mode == "next" else _FILL_LAST).replace("{dom}", dom)


def sql() -> dict[str, str]:
    lines = _lines_sql()
    return {
        "training_pairs": f"WITH {lines} SELECT line_id, pos, term, label FROM pairs",
        "training_backfill_last": f"WITH {_lines_sql('last')} SELECT line_id, pos, term, label FROM pairs",
        "training_rejects": f"WITH {lines} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "training_xml": f"""WITH {lines}
SELECT line_id, md5('<TokenSequence>' || string_agg('<' || label || '>' ||
    replace(replace(replace(term, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || label || '> ', '' ORDER BY pos)
    || '</TokenSequence>') AS xml_md5
FROM pairs GROUP BY line_id""",
        "gazetteer_mine": f"WITH {lines} SELECT label, term, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY label, term",
        "label_vocab": f"""WITH {lines}
SELECT label, CAST(count(*) AS BIGINT) AS n_terms, CAST(count(DISTINCT line_id) AS BIGINT) AS n_lines
FROM pairs GROUP BY label""",
        "tag_group": f"""WITH {_SEQ}
SELECT okey AS o_orderkey, label, CAST(min(pos) AS INT) AS first_pos,
       regexp_replace(string_agg(token, ' ' ORDER BY pos), '^[ ,;]+|[ ,;]+$', '', 'g') AS text
FROM tok GROUP BY okey, label""",
        "merge_runs": f"""WITH {_RUNS.replace('{cols}', '1 AS x')}
SELECT okey AS o_orderkey, CAST(pos AS INT) AS pos, label, term FROM runs""",
        "labels_to_columns": f"WITH {_cols_sql()} SELECT * FROM cols",
        "columns_to_entities": f"""WITH {_cols_sql()},
ent AS ({_unpivot()})
SELECT o_orderkey, type, entity FROM ent""",
        "first_seen_dedupe": f"""WITH {_cols_sql()},
ent AS ({_unpivot()})
SELECT entity, arg_min(o_orderkey, (o_orderkey, type_ord)) AS o_orderkey,
       arg_min(type, (o_orderkey, type_ord)) AS type
FROM ent GROUP BY entity""",
        "last_wins": f"""WITH {_cols_sql()},
ent AS ({_unpivot()})
SELECT type, entity, max(o_orderkey) AS o_orderkey FROM ent GROUP BY type, entity""",
    }


def _unpivot():
    parts = []
    for i, t in enumerate(fixed.ENTITY_TYPES):
        parts.append(f"SELECT o_orderkey, '{t}' AS type, {i} AS type_ord, "
                     f"regexp_replace(\"{t}\", '^\\s+|\\s+$', '', 'g') AS entity FROM cols")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE entity <> ''"
