"""Tokeniser cases: the original unit tests plus the pattern's edge cases."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T


def tok(spark, s):
    return spark.createDataFrame([(s,)], "s string").select(T.tokenize("s").alias("t")).first()["t"]


@pytest.mark.parametrize("raw, tokens", [
    ("foo,bar", ["foo,", "bar"]),
    ("foo bar", ["foo", "bar"]),
    ("foo  bar", ["foo", "bar"]),
    ("foo bar ", ["foo", "bar"]),
    (" foo bar", ["foo", "bar"]),
    ("13cb", ["13", "cb"]),
    ("a1b2c", ["a1", "b2", "c"]),
    ("c/o x", ["c/o", "x"]),
    ("a/c", ["a", "/", "c"]),
    ("#3 & @me", ["#", "3", "&", "@", "me"]),
    ('(hi) "yo".', ["(hi)", '"yo".']),
    ("", []),
    ("--", []),
])
def test_tokenize(spark, raw, tokens):
    assert tok(spark, raw) == tokens


def test_null_text_gives_empty(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(T.tokenize("s").alias("t")).first()["t"] == []


def test_clean_and_abbrev(spark):
    df = spark.createDataFrame([("(Kitchen's,",), ("&",), ("A.C.",)], "t string")
    rows = df.select(T.clean_token("t").alias("c"), T.abbrev_token("t").alias("a")).collect()
    assert [(r.c, r.a) for r in rows] == [("kitchen's", "kitchens"), ("&", "&"), ("a.c.", "ac")]


def test_normalize(spark):
    df = spark.createDataFrame([("  Café  OK\n now ",)], "t string")
    assert df.select(T.normalize("t").alias("n")).first()["n"] == "caf ok now"
