"""Smaller operators: gazetteer table join, optional shapes, decode, parse log, distinct vector lines."""

import os
import tempfile

from pyspark.sql import functions as F

from wordloom.functions import shape as S
from wordloom.functions import text as T
from wordloom.operators import features as FE
from wordloom.sources import readers as R
from wordloom.sources import sinks as K


def test_gazetteer_table_equals_literals(spark):
    toks = spark.createDataFrame([(t,) for t in ["kitchen", "sink", "on", "of", "of,", "kitchen,", "ac", "zzz", "door"]],
                                 "token string")
    a = {r.token: (r.is_location, r.is_object, r.prepositions) for r in FE.gazetteer_flags(toks, "token").collect()}
    b = {r.token: (r.is_location, r.is_object, r.prepositions)
         for r in FE.gazetteer_flags(toks, "token", FE.gazetteer_table(spark)).collect()}
    assert a == b
    assert a["kitchen"] == (True, True, False) and a["ac"] == (False, False, False) and a["of,"][2] is True


def test_pos_lookup(spark):
    lex = spark.createDataFrame([("fix", "VB", 1), ("fix", "NN", 2), ("sink", "NN", 1)], "word string, tag string, ord int")
    toks = spark.createDataFrame([("fix",), ("sink",), ("zz",)], "token string")
    got = {r.token: (r.nouns_count, r.verbs_count, r.nltk_tag) for r in FE.with_pos(toks, "token", lex).collect()}
    assert got == {"fix": (1, 1, "NN"), "sink": (1, 0, "NN"), "zz": (0, 0, "")}


def test_optional_shapes(spark):
    df = spark.createDataFrame([("Hello",), ("HVAC",), ("iv",), ("x-ray",), ("A.",), ("120",)], "t string")
    rows = df.select("t", S.casing("t").alias("c"), S.roman("t").alias("r"), S.hyphenated("t").alias("h"),
                     S.length_code("t").alias("lc"), S.digits("t").alias("d")).collect()
    got = {r.t: (r.c, r.r, r.h, r.lc, r.d) for r in rows}
    assert got["Hello"][0] == "title" and got["HVAC"][0] == "upper" and got["iv"][1] is True
    assert got["x-ray"][2] is True and got["120"][3] == "d:3" and got["120"][4] == "all_digits"


def test_decode_and_parse_log(spark):
    df = spark.createDataFrame([(bytearray("café".encode()),)], "b binary")
    assert df.select(T.decode_utf8("b").alias("s")).first()["s"] == "café"
    d = os.path.join(tempfile.mkdtemp(), "log")
    lab = spark.createDataFrame([("fix sink", ["fix", "sink"], ["action", "object"])],
                                "line string, tokens array<string>, labels array<string>")
    K.write_parse_log(lab, "line", "tokens", "labels", d)
    assert spark.read.text(d).first()["value"] == 'fix sink--> [["fix","action"],["sink","object"]]'


def test_distinct_vector_lines(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "v.txt"), "w") as f:
        f.write("object\tsink\t[ 1 2]\nobject\tsink\t[ 1 2]\n")
    assert R.read_entity_vectors_text(spark, d).count() == 2
    assert R.read_entity_vectors_text(spark, d, distinct=True).count() == 1
