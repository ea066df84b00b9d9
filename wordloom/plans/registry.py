"""All registered queries over the driver tables and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

from wordloom.session import ensure_checkpoint_dir

MODULES = ["wordloom.plans.q_text", "wordloom.plans.q_labels", "wordloom.plans.q_vectors",
           "wordloom.plans.q_cluster", "wordloom.plans.q_clean",
           "wordloom.plans.q_sequence", "wordloom.plans.q_io", "wordloom.plans.q_files",
           "wordloom.plans.flagship"]


def _prepared(fn):
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)  # the session's spark.checkpoint.dir when set
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update({k: _prepared(v) for k, v in importlib.import_module(m).QUERIES.items()})
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(m).sql())
    return out
