"""Flagship chain: clean -> tokenise -> label -> entity columns over the documents.

Documents play the work orders (address = source, category = lang,
description = text).  Phrases and spelling are cleaned with the tables of
``q_clean``; the sequence model is fitted on the training lines derived
from the order tables of the same folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import clean as CL
from wordloom.operators import labels as L
from wordloom.operators import sequence as SQ
from wordloom.plans import q_clean as QC
from wordloom.plans import q_labels as QL
from wordloom.plans import q_sequence as QS
from wordloom.plans.common import load


def flagship(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("address"), F.col("lang").alias("category"),
        T.normalize("text").alias("description"), F.lit("").alias("unit"))
    cleaned = CL.preclean(docs, "doc_id", "description", CL.synonym_table(spark, QC.EXTRA_PHRASES),
                          QC.dictionary(spark, sf_dir), out="cleaned")
    lex = QS.lexicon(spark)
    model = SQ.fit(SQ.training_sequences(QL.parsed_lines(spark, sf_dir)), lexicon=lex)
    lab = SQ.label_tokens(cleaned, "cleaned", model, lex).drop("cleaned")
    cols = L.with_label_columns(lab, "tokens", "labels")
    return cols.select("doc_id", "address", "category", "description", "unit",
                       *[("ent_description" if c == "description" else c) for c in fixed.LABELS], fixed.OBJECT2)


def q_label_work_orders(spark, sf):
    """PIPE-1 / SEQ-3 chain on the documents (flagship), digested per document."""
    f = flagship(spark, sf)
    cols = [("ent_description" if c == "description" else c) for c in fixed.LABELS] + [fixed.OBJECT2]
    return f.select("doc_id", *[F.md5(F.col(c)).alias(c) for c in cols])


QUERIES = {"label_work_orders": q_label_work_orders}


def sql() -> dict[str, str]:
    return {}
