"""Plan-shape guards: checked broadcast, and no double evaluation of derived arrays."""

from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import labels as L
from wordloom.operators import tokens as TK
from wordloom.session import checked_broadcast, estimated_bytes


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_checked_broadcast(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert _hinted(checked_broadcast(small, max_rows=100))
    assert not _hinted(checked_broadcast(big, max_rows=100))
    assert estimated_bytes(small) is not None


def test_explode_does_not_rebuild_the_array(spark):
    df = spark.createDataFrame([(1, "Hello World 13cb"), (2, "")], "id long, t string")
    ex = TK.explode_with_pos(df, "id", T.tokenize(T.normalize("t")), "pos", "tok")
    plan = _plan(ex)
    assert plan.count("regexp_extract_all") == 1          # the token array is built once
    assert sorted((r.id, r.tok) for r in ex.collect()) == [(1, "13"), (1, "cb"), (1, "hello"), (1, "world")]


def test_keep_rows_does_not_push_the_derivation(spark):
    df = spark.createDataFrame([(1, "a,action"), (2, "b,colour")], "line_id long, line string")
    parsed = L.parse_training_lines(df, "line", "line_id")
    kept = L.keep_rows(parsed, F.col("reason").isNull())
    assert _plan(kept).count("split(") == 1                # the line is split once
    assert [r.line_id for r in kept.collect()] == [1]


def test_let_binds_once(spark):
    df = spark.createDataFrame([("a b c",)], "t string")
    arr = F.split(F.upper("t"), " ")
    c = T.let(arr, lambda a: F.transform(a, lambda x, i: F.concat(x, F.get(a, i))))
    assert df.select(c.alias("v")).first()["v"] == ["AA", "BB", "CC"]


def test_registered_plans_read_only_their_columns(spark):
    from wordloom.plans.registry import queries
    q = queries()
    for name, columns in (("tokenize", {"doc_id", "text"}), ("type_filter", {"p_partkey", "p_name", "p_type"}),
                          ("stopword_filter", {"doc_id", "text"}), ("cluster_sizes_k", {"label"})):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        read = plan.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
        assert {c.split(":")[0] for c in read.split(",")} <= columns, (name, read)
    plan = q["type_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(p_type" in plan


def test_no_row_limit_by_default():
    from wordloom.plans.pipeline import PipelineConfig
    assert PipelineConfig().row_limit == 0


def test_checkpoint_folder_must_be_named_off_local_mode():
    import pytest

    from wordloom.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
