"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, secret scans, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each stage's result as Parquet below the shared checkpoint folder and reads
it back as the next stage's documents, so a lost executor costs part of one
stage.  All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import stages
from wordloom.session import ensure_checkpoint_dir, stage_path

STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("line_dedup", stages.line_dedup_stage),
    ("simhash_dedup", stages.simhash_stage),
    ("secret_scan", stages.secret_stage),
    ("best_fit_packing", stages.packing_stage),
]

# The stages hash, classify and pack by rules that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
