"""Stages of the corpus pipeline: each applies one operator to the documents and lets its decision take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import line_dedup, packing, secrets, simhash, toxicity
from wordloom.llm.batches import small_batches
from wordloom.llm.graph import written
from wordloom.llm.row_keys import with_row_keys
from wordloom.llm.sieve import left_join_some

# What stands where a secret stood.
REDACTED = "[SECRET]"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score lies below their language's cut; the model learns from the `labels` table beside them."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.with_score(docs, model, "_toxicity").where(F.col("_toxicity") < toxicity.cut_column(F.col("lang"), model)).drop("_toxicity")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; every document stays."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row, of the document with the smallest id; rows with a null id stay."""
    small_batches(spark)
    rows = with_row_keys(docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row")), F.col("row.text")).where("not again").drop("again")
    found = simhash.near_copies(rows.select("id", "version", F.col("row.text").cast("string").alias("text")), shingle=3, radius=3)
    gone = written(found.withColumn("gone", F.lit(True)), "near_copies")
    return left_join_some(rows, gone, "id", "version").where("gone is null").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced; documents without secrets are untouched."""
    small_batches(spark)
    return secrets.redact(docs, REDACTED).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs)
