"""Shared helpers for the registered queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# SQL fragments shared by the oracle strings (DuckDB dialect).
def sql_ascii(expr: str) -> str:
    return f"regexp_replace(coalesce({expr}, ''), '[^\\x00-\\x7F]', '', 'g')"


def sql_normalize(expr: str) -> str:
    return f"trim(regexp_replace(lower({sql_ascii(expr)}), '\\s+', ' ', 'g'))"


def sql_tokens(expr: str) -> str:
    from wordloom import fixed
    pat = fixed.TOKEN_PATTERN.replace("'", "''")
    split = f"regexp_replace({expr}, '([0-9])([a-zA-Z])', '\\1 \\2', 'g')"
    return f"regexp_extract_all({split}, '{pat}', 0)"
