"""Registered queries of the operators, each over its whole table.

No query here has an oracle in SQL: what they return follows from hashes,
trained weights or byte-level rules that DuckDB doesn't have, so each is
tested against a brute-force version in `tests/llm`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (
    bpe, conversation_repair, html_text, line_dedup, packing, prefix_trie, secrets, simhash, substring_dedup, suffix_dedup, topk_search, toxicity, vector_near_dup)
from wordloom.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_topk_search(spark, sf_dir):
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), k=5).withColumnRenamed("id", "vec_id")


def op2_secret_scan(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op3_simhash(spark, sf_dir):
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op4_embedding_dedup(spark, sf_dir):
    found = vector_near_dup.vector_links(_table(spark, sf_dir, "embeddings"), threshold=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_bpe(spark, sf_dir):
    done = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep_ids=False)
    return done.withColumnRenamed("id", "doc_id")


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=35, keep_text=False).withColumnRenamed("id", "doc_id")


def op9_html_text(spark, sf_dir):
    return html_text.extract_main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_keys(_table(spark, sf_dir, "conversations"))))


def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"), window=200, keep_text=False).withColumnRenamed("id", "doc_id")


def op13_conversation_repair(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair_conversations(conversation_repair.damaged(turns), ids=turns)


QUERIES = {f.__name__: f for f in (
    op1_topk_search, op2_secret_scan, op3_simhash, op4_embedding_dedup, op5_bpe, op6_best_fit_packing, op7_toxicity, op8_substring_dedup,
    op9_html_text, op10_line_dedup, op11_prefix_trie, op12_suffix_dedup, op13_conversation_repair)}


def sql() -> dict[str, str]:
    return {}
