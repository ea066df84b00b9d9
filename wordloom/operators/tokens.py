"""Tokenising, n-grams and stopwords as DataFrame transforms."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T


def explode_with_pos(df: DataFrame, keep, arr, pos: str = "pos", value: str = "value") -> DataFrame:
    """``posexplode`` of ``arr`` keeping the ``keep`` columns; empty/null arrays give no rows.

    A plain (non-outer) explode makes the optimizer infer ``size(arr) > 0``
    and push that filter below the projection that builds ``arr``, so the
    array (tokens, n-grams, features) would be computed twice.  The outer
    form plus a filter on the produced position computes it once.
    """
    keep = [keep] if isinstance(keep, str) else list(keep)
    a = F.col(arr) if isinstance(arr, str) else arr
    return (df.select(*keep, F.posexplode_outer(a).alias(pos, value))
              .where(F.col(pos).isNotNull()))


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """TOK-1 + TOK-2 on one column; the tokens stay one array per row (no shuffle)."""
    return df.withColumn(out, T.tokenize(text_col))


def explode_tokens(df: DataFrame, id_cols, tokens_col: str = "tokens",
                   pos: str = "pos", token: str = "token") -> DataFrame:
    """Long form ``(*id_cols, pos, token)``: one row per token, position from 0."""
    return explode_with_pos(df, id_cols, tokens_col, pos, token)


def token_counts(df: DataFrame, text_col: str = "text", normalize: bool = True) -> DataFrame:
    """Corpus token frequencies ``(token, n)``.

    Map-side partial aggregation keeps the shuffle to one row per distinct
    token per partition, so a hot token costs no more than a cold one.
    """
    src = T.normalize(text_col) if normalize else F.col(text_col)
    return (explode_with_pos(df, [], T.tokenize(src), "_p", "token")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def ngram_spans(words, max_n: int = fixed.MAX_NGRAM) -> Column:
    """TOK-5: all n-grams longest first (n = max_n .. 1), left to right.

    Returns ``array<struct<n int, start int, gram string>>``.  A text with
    fewer than n words contributes nothing for that n.
    """
    def spans(w):
        size = F.size(w)

        def per_n(n):
            starts = F.when(size >= n, F.sequence(F.lit(0), size - n)) \
                      .otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.struct(
                n.cast("int").alias("n"), i.cast("int").alias("start"),
                F.array_join(F.slice(w, i + 1, n), " ").alias("gram")))

        return F.flatten(F.transform(F.sequence(F.lit(max_n), F.lit(1), F.lit(-1)), per_n))

    return T.let(words, spans)


def explode_ngrams(df: DataFrame, id_cols, words_col: str, max_n: int = fixed.MAX_NGRAM) -> DataFrame:
    """Long form ``(*id_cols, n, start, gram, ord)``; ``ord`` is the longest-first order."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return (explode_with_pos(df, ids, ngram_spans(words_col, max_n), "ord", "span")
              .select(*ids, "span.n", "span.start", "span.gram", "ord"))


def english_stopwords() -> list[str]:
    """Default English stopword list of Spark ML; without a running session it is read from Spark's jar."""
    from pyspark import SparkContext
    if SparkContext._active_spark_context is not None:
        return list(StopWordsRemover.loadDefaultStopWords("english"))
    import glob
    import os
    import zipfile

    import pyspark
    jar = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as z:
        return [w for w in z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8").split("\n") if w]


def remove_stopwords(df: DataFrame, words_col: str, out: str, stopwords: list[str] | None = None,
                     case_sensitive: bool = True) -> DataFrame:
    """TOK-6: drop stopwords from an array column (JVM hash-set lookup via ``StopWordsRemover``)."""
    r = StopWordsRemover(inputCol=words_col, outputCol=out, stopWords=stopwords or english_stopwords(),
                         caseSensitive=case_sensitive)
    return r.transform(df)
