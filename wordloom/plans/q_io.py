"""Registered queries: sources and sinks (round trips through the shared folder), row limit, type filter.

Round trips write their files under ``spark.checkpoint.dir`` (the shared
folder of the cluster) and read them back with the readers, in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import labels as L
from wordloom.plans import q_labels as QL
from wordloom.plans.common import load
from wordloom.plans.pipeline import PipelineConfig, run_pipeline
from wordloom.session import first_rows, stage_path
from wordloom.sources import readers as R
from wordloom.sources import sinks as K

NS = "urn:schemas-microsoft-com:office:spreadsheet"
HEADER = ["id", "created_date", "company_id", "job_order_number", "portfolio_name",
          "address", "unit", "category", "description"]


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _cell(c, index):
    """A cell with its column's index; none for a null."""
    return F.coalesce(F.concat(F.lit(f'<Cell ss:Index="{index}"><Data ss:Type="String">'), _xml_escape(c.cast("string")), F.lit("</Data></Cell>")), F.lit(""))


def write_spreadsheet_xml(df, cols, path):
    """Rows as SpreadsheetML; every part file is a workbook with its own header row."""
    row = F.concat(F.lit("<Row>"), *[_cell(F.col(c), i) for i, c in enumerate(cols, 1)], F.lit("</Row>"))
    head = "<Row>" + "".join(f'<Cell><Data ss:Type="String">{h}</Data></Cell>' for h in cols) + "</Row>"
    top = f'<?xml version="1.0"?><Workbook xmlns="{NS}" xmlns:ss="{NS}"><Worksheet ss:Name="s"><Table>'

    def wrap(batches):
        yield pd.DataFrame({"value": [top, head]})
        for pdf in batches:
            yield pdf
        yield pd.DataFrame({"value": ["</Table></Worksheet></Workbook>"]})

    df.select(row.alias("value")).mapInPandas(wrap, "value string").write.mode("overwrite").text(path)


def _export(spark, sf):
    """Orders with customers and item names, written as two folders of workbooks with different column orders; their paths.

    Open orders that are urgent have none of the work-order fields.
    """
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    items = QL.order_sequences(spark, sf).select("o_orderkey", F.array_join("tokens", " ").alias("items"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(items, "o_orderkey", "left")
    full = ~((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
    src = j.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_date"),
                   F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("job_order_number"),
                   F.col("c_mktsegment").alias("portfolio_name"), F.when(full, F.col("c_name")).alias("address"),
                   F.when(full, F.col("o_orderstatus")).alias("unit"), F.when(full, F.col("o_orderpriority")).alias("category"),
                   F.when(full, F.col("items")).alias("description"))
    paths = []
    half = F.pmod(F.col("id"), F.lit(2)) == 0
    for rows, cols in ((src.where(half), HEADER), (src.where(~half), HEADER[::-1])):
        paths.append(stage_path(spark, "xml"))
        write_spreadsheet_xml(rows, cols, paths[-1])
    return paths


def q_xml_work_orders(spark, sf):
    """SRC-1 / SRC-2 / CLN-7: orders with customers and item names as a spreadsheet export, read back as work orders."""
    wo = R.raw_to_work_orders(R.read_spreadsheet_table(spark, _export(spark, sf)))
    return wo.select("address", "category", F.md5("description").alias("description_md5"), "unit")


def q_xml_rejects(spark, sf):
    """SRC-2: the export's rows that hold no work-order field, by their id."""
    table = R.read_spreadsheet_table(spark, _export(spark, sf))
    return R.raw_rejects(table, ("id",)).select(F.col("id").cast("bigint").alias("o_orderkey"), "reason")


def q_ingest_counters(spark, sf):
    """AGG-9: the row counts that the ingest stage observes while it writes."""
    counters = {}
    run_pipeline(spark, PipelineConfig(raw_xml=_export(spark, sf), stages=["ingest"]), counters)
    return spark.createDataFrame(sorted(counters.items()), "counter string, n long")


def q_tsv_round_trip(spark, sf):
    """SNK-2 / SRC-6: labelled orders written as the 13-column TSV, read back and melted to entities."""
    cols = QL.labelled_columns(spark, sf)
    lab = cols.select(F.col("o_orderkey").cast("string").alias("address"), F.lit("parts").alias("category"),
                      F.concat_ws(" ", "object", "description").alias("description"), F.lit("").alias("unit"),
                      "location", "object", "action", "numerator", "analysis",
                      F.col("description").alias("ent_description"), "conjunction", "noise", "object2")
    path = stage_path(spark, "tsv")
    K.write_labelled(lab, path)
    back = R.read_labelled(spark, path)
    return R.labelled_entities(back).select("type", "entity")


def q_entity_vector_text(spark, sf):
    """SRC-8: entity vectors in the bracketed text form, wrapped over several lines, read back."""
    e = load(spark, sf, "embeddings")
    vals = F.transform("embedding", lambda x: F.format_number(x.cast("double"), 8))
    # eight numbers per line, like a printed array
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size(vals) - 1) / 8).cast("int")),
                        lambda i: F.array_join(F.slice(vals, i * 8 + 1, 8), " "))
    text = F.concat(F.col("label").cast("string"), F.lit("\t"), F.concat(F.lit("e"), F.col("vec_id").cast("string")),
                    F.lit("\t[ "), F.array_join(lines, "\n  "), F.lit("]"))
    path = stage_path(spark, "vec")
    e.select(text.alias("value")).write.mode("overwrite").text(path)
    back = R.read_entity_vectors_text(spark, path)
    return back.select("type", "entity", F.size("vec").alias("dim"),
                       F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("vec_sum"))


def q_training_xml_file(spark, sf):
    """SNK-1 and its reader: training sequences written as XML part files and read back; how often each sequence occurs."""
    parsed = QL.parsed_lines(spark, sf)
    path = stage_path(spark, "trainxml")
    K.write_training_xml(parsed, path)
    back = R.read_training_xml(spark, path)
    text = F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["label"], p["term"])), "|")
    return back.groupBy(F.md5(text).alias("sequence_md5")).agg(F.count(F.lit(1)).alias("n"), F.first(F.size("pairs")).alias("n_pairs"))


def q_limited_rows(spark, sf):
    """ORD-2: the first 200 documents by id (the row limit is the feature), by counting instead of sorting."""
    d = first_rows(load(spark, sf, "documents"), "doc_id", 200)
    return d.select("doc_id", "lang", F.col("n_chars").cast("bigint").alias("n_chars"))


def q_type_filter(spark, sf):
    """ORD-3: entities of selected types only (filter pushed to the scan)."""
    p = load(spark, sf, "part")
    return p.where(F.col("p_type").isin("SMALL", "LARGE")).select(
        "p_partkey", F.col("p_type").alias("type"), T.normalize("p_name").alias("entity"))


QUERIES = {
    "xml_work_orders": q_xml_work_orders,
    "xml_rejects": q_xml_rejects,
    "ingest_counters": q_ingest_counters,
    "tsv_round_trip": q_tsv_round_trip,
    "entity_vector_text": q_entity_vector_text,
    "training_xml_file": q_training_xml_file,
    "limited_rows": q_limited_rows,
    "type_filter": q_type_filter,
}


def sql() -> dict[str, str]:
    from wordloom.plans.common import sql_normalize
    return {
        "xml_work_orders": f"""WITH {QL._SEQ}
SELECT c.c_name AS address, o.o_orderpriority AS category, md5(coalesce(array_to_string(seq.tokens, ' '), '')) AS description_md5,
       o.o_orderstatus AS unit
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN seq ON seq.okey = o.o_orderkey
WHERE NOT (o.o_orderstatus = 'O' AND o.o_orderpriority = '1-URGENT')""",
        "xml_rejects": "SELECT o_orderkey, 'no work-order field' AS reason FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
        "ingest_counters": """
SELECT CASE WHEN bad THEN 'raw_rejects' ELSE 'work_orders' END AS counter, count(*) AS n
FROM (SELECT o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AS bad FROM orders) GROUP BY bad""",
        "tsv_round_trip": f"""WITH {QL._cols_sql()},
ent AS ({QL._unpivot()})
SELECT type, entity FROM ent""",
        "entity_vector_text": """
SELECT CAST(label AS VARCHAR) AS type, 'e' || vec_id AS entity, CAST(len(embedding) AS INT) AS dim,
       round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 8))), 4) AS vec_sum FROM embeddings""",
        "training_xml_file": f"""WITH {QL._lines_sql()},
s AS (SELECT line_id, string_agg(label || '=' || term, '|' ORDER BY pos) AS t, count(*) AS k FROM pairs GROUP BY line_id)
SELECT md5(t) AS sequence_md5, count(*) AS n, CAST(first(k) AS INT) AS n_pairs FROM s GROUP BY t""",
        "limited_rows": "SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents ORDER BY doc_id LIMIT 200",
        "type_filter": f"SELECT p_partkey, p_type AS type, {sql_normalize('p_name')} AS entity FROM part "
                       "WHERE p_type IN ('SMALL', 'LARGE')",
    }
