import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes a documents table of texts; rows may be (id, text) pairs."""
    def make(texts, parts=3, extra=False):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{0 if i is None else i % 2}", len(t or "")) for i, t in rows], DOCS).repartition(parts)
        # columns whose names the operators use themselves
        clash = ["id", "words", "row", "gone", "fp", "key", "vec", "shard"]
        return df.selectExpr("*", *[f"'x' as {c}" for c in clash]) if extra else df
    return make
