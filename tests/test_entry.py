"""Driver contract: entry() runs; every query has a callable; oracle keys are queries."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_contract(spark):
    m = load_entry()
    q, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 50
    df = m.entry(spark)
    assert "ent_description" in df.columns and "object2" in df.columns
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{m.SMOKE_DIR}/documents.parquet").count()
    assert any(r["object"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)


def test_works_without_the_optional_parts(spark, monkeypatch):
    import sys
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # an import of it fails
    m = load_entry()
    assert "pipeline" not in m.queries() and not [n for n in m.queries() if n.startswith("op1_")]
    assert set(m.oracle_sql()) <= set(m.queries()) and "tokenize" in m.queries()
