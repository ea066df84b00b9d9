"""Word vectors, IDF weights, n-gram segmentation and entity -> vector resolution.

Vector tables are DataFrames ``(term, vec array<float|double>)`` whose keys
use ``_`` for blanks (TOK-7).  Every lookup is an equi-join: the side table
is broadcast only when a bounded row check passes, otherwise both sides
shuffle on the key (a 3M-row pre-trained table is a shuffle join, never a
driver-side dictionary).  Per-text steps keep their spans in one row, so
the only shuffles are the lookups and the corpus-wide document frequencies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import tokens as TK
from wordloom.operators.cover import greedy_cover
from wordloom.session import checked_broadcast, ensure_checkpoint_dir, stage_path


# ---------------------------------------------------------------------------
# scalar vector expressions
# ---------------------------------------------------------------------------

def as_double(vec) -> Column:
    return F.transform(T._c(vec), lambda x: x.cast("double"))


def l2_norm(vec) -> Column:
    """VEC-7: Euclidean length."""
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda a, x: a + x * x))


def normalized(vec) -> Column:
    """VEC-8: unit-length copy (a zero vector stays zero)."""
    return T.let(as_double(vec), lambda v: T.let(l2_norm(v), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def scaled(vec, w) -> Column:
    """VEC-5: vector times a scalar weight."""
    return F.transform(as_double(vec), lambda x: x * T._c(w))


def vec_sum(vecs) -> Column:
    """Element-wise sum of an ``array<array<double>>`` (null when empty)."""
    vs = T._c(vecs)
    zero = F.transform(F.get(vs, 0), lambda x: F.lit(0.0))
    return F.when(F.size(vs) > 0, F.aggregate(vs, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)))


def vec_mean(vecs) -> Column:
    """AGG-7 in-row: element-wise mean of an array of vectors; null when there is none (Q9)."""
    return T.let(vecs, lambda vs: T.let(F.size(vs), lambda k: F.transform(vec_sum(vs), lambda x: x / k)))


def vector_bucket(term, modulus: int) -> Column:
    """Deterministic bucket of a term: first 32 bits of md5 modulo ``modulus``."""
    h = F.conv(F.substring(F.md5(T._c(term)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(modulus))


# ---------------------------------------------------------------------------
# JOIN-1: term -> vector
# ---------------------------------------------------------------------------

def lookup_vectors(df: DataFrame, term_col: str, vectors: DataFrame, out: str = "vec",
                   key_col: str = "term", vec_col: str = "vec") -> DataFrame:
    """Left join on the vector key (blanks -> ``_``); ``out`` is null when unknown."""
    v = vectors.select(F.col(key_col).alias("_vkey"), F.col(vec_col).alias(out))
    d = df.withColumn("_vkey", T.vector_key(term_col))
    return d.join(checked_broadcast(v), "_vkey", "left").drop("_vkey")


# ---------------------------------------------------------------------------
# AGG-4 .. AGG-6, JOIN-6: IDF per type over 1..4-grams
# ---------------------------------------------------------------------------

def idf_by_type(df: DataFrame, type_col: str, text_col: str, max_n: int = fixed.MAX_NGRAM) -> DataFrame:
    """Smoothed IDF ``ln((1 + n) / (1 + df)) + 1`` per ``(type, gram)``.

    ``n`` is the number of texts of the type (duplicates kept), ``df`` the
    number of texts containing the gram.  Grams come from TOK-4 words.  The
    per-text distinct grams are built in-row; the only shuffle is the
    partially aggregated count per (type, gram).
    """
    words = T.idf_terms(text_col)
    grams = F.array_distinct(F.transform(TK.ngram_spans(words, max_n), lambda s: s["gram"]))
    docs = df.select(F.col(type_col).alias("type"), grams.alias("_g"))
    dfreq = TK.explode_with_pos(docs, "type", "_g", "_p", "gram").groupBy("type", "gram").agg(
        F.count(F.lit(1)).alias("df"))
    ndocs = docs.groupBy("type").agg(F.count(F.lit(1)).alias("n_docs"))
    out = dfreq.join(checked_broadcast(ndocs), "type")
    return out.withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)


def max_idf(idf: DataFrame) -> DataFrame:
    """AGG-6: the weight of a type's terms that it has no weight for: that of its rarest term."""
    return idf.groupBy("type").agg(F.max("idf").alias("max_idf"))


def with_weights(df: DataFrame, type_col: str, term_col: str, idf: DataFrame | None,
                 out: str = "weight") -> DataFrame:
    """JOIN-6: ``coalesce(idf(type, term), max_idf(type), 1)``; 1 everywhere without weights (Q8).

    ``idf`` is computed once: one pass keeps the weights of the terms that
    ``df`` asks for and, of all others, the greatest of each type.  What is
    kept, a row a term asked for, is stored and joined.  The planner takes a
    table of n-grams for as small as the file it comes from, so no side of
    these joins is left to its estimate.
    """
    if idf is None:
        return df.withColumn(out, F.lit(1.0))
    asked = df.select(F.col(type_col).alias("_t"), F.col(term_col).alias("_g")).distinct().withColumn("_asked", F.lit(True))
    w = idf.select(F.col("type").alias("_t"), F.col("gram").alias("_g"), F.col("idf").alias("_idf"))
    kept = w.join(asked.hint("shuffle_hash"), ["_t", "_g"], "left") \
        .groupBy("_t", F.when(F.col("_asked"), F.col("_g")).alias("_g"), F.when(F.col("_asked"), F.col("_idf")).alias("_w")) \
        .agg(F.max("_idf").alias("idf"), F.count(F.lit(1)).alias("_n"))
    path = stage_path(df.sparkSession, "weights")
    kept.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    # a weight that ``idf`` has several times counts as often
    found = kept.where(F.col("_g").isNotNull()).select("_t", "_g", F.col("_w").alias("_idf"), F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("col")
    side = _checked_side(found)
    mx = max_idf(kept.withColumnRenamed("_t", "type")).select(F.col("type").alias("_t"), "max_idf")
    j = df.join(side, (df[type_col] == side["_t"]) & (df[term_col] == side["_g"]), "left").drop("_t", "_g")
    j = j.join(checked_broadcast(mx), j[type_col] == mx["_t"], "left").drop("_t")
    return j.withColumn(out, F.coalesce("_idf", "max_idf", F.lit(1.0))).drop("_idf", "max_idf")


# ---------------------------------------------------------------------------
# AGG-7 / VEC-4: means
# ---------------------------------------------------------------------------

def mean_vectors(df: DataFrame, group_cols, vec_col: str = "vec", weight_col: str | None = None,
                 out: str = "vec") -> DataFrame:
    """Mean of (optionally weighted) vectors per group, null vectors skipped.

    Uses ``Summarizer.mean`` inside ``groupBy().agg``: one shuffle with
    map-side partial sums, so a hot group is pre-reduced on every executor.
    """
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    v = F.col(vec_col) if weight_col is None else scaled(vec_col, F.col(weight_col))
    src = df.where(F.col(vec_col).isNotNull()).select(*keys, array_to_vector(as_double(v)).alias("_v"))
    agg = src.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n_found"))
    return agg.select(*keys, vector_to_array("_m").alias(out), "n_found")


# ---------------------------------------------------------------------------
# SEG-1: longest-known-n-gram segmentation
# ---------------------------------------------------------------------------

# A vector table up to this size is broadcast to the chosen grams; it is checked before.
VECTOR_ROWS, VECTOR_BYTES = 1_000_000, 1 << 30


def _checked_side(df: DataFrame, *bounds: int) -> DataFrame:
    """``df`` broadcast within the (checked) bounds, else shuffled: the planner takes n-grams for as small as their texts' file."""
    side = checked_broadcast(df, *bounds)
    return df.hint("merge") if side is df else side


def segment(df: DataFrame, id_col: str, text_col: str, vectors: DataFrame, max_n: int = fixed.MAX_NGRAM,
            lower: bool = True, stopwords: list[str] | None = None, key_col: str = "term",
            vec_col: str = "vec", drop_stopwords: bool = True, keys: DataFrame | None = None) -> DataFrame:
    """Cover each text with the longest known n-grams, then average their vectors.

    Spans are taken in (length desc, start asc) order when none of their
    words is already covered.  Q6: with ``drop_stopwords`` a single-word
    gram that is a stopword (``stopwords``, default the English list) is
    never used.  A gram chosen at several places counts once in the
    mean (Q13).  Returns ``(id, grams array<string>, n_grams, vec)`` for
    every input id (``vec`` null when nothing is known).

    Plan: spans meet the vector keys (no vectors move), the matches of a
    text are resolved in-row, and only the chosen grams are joined to
    their vectors and averaged (``Summarizer``, partial aggregation).

    Where many terms share a vector, ``keys`` (``key_col`` unique, ``vec_id``)
    names each term's, and ``vectors`` is (``vec_id``, ``vec_col``).  The
    spans then bring the number along, so terms are shuffled once.
    """
    words = T.space_split(F.lower(F.col(text_col)) if lower else F.col(text_col))
    spans = TK.explode_ngrams(df.select(id_col, words.alias("_w")), id_col, "_w", max_n)
    if drop_stopwords:
        stop = stopwords if stopwords is not None else TK.english_stopwords()
        spans = spans.where(~((F.col("n") == 1) & F.col("gram").isin(*stop)))
    # shuffled: the place in one number, and the gram, which tells its length
    spans = spans.select(id_col, F.shiftleft(F.col("ord").cast("long"), 32).bitwiseOR(F.col("start").cast("long")).alias("place"), "gram")
    if keys is None:
        known = _checked_side(vectors.select(F.col(key_col).alias("_vkey")))
        hits = spans.join(known, T.vector_key("gram") == F.col("_vkey"), "left_semi").withColumn("number", F.lit(None).cast("long"))
    else:
        known = _checked_side(keys.select(F.col(key_col).alias("_vkey"), F.col("vec_id").cast("long").alias("number")))
        hits = spans.join(known, T.vector_key("gram") == F.col("_vkey")).drop("_vkey")
    n = lambda gram: (F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1).cast("int")
    per = hits.groupBy(id_col).agg(F.collect_list(F.struct("place", "gram", "number")).alias("_hits"))
    per = per.select(id_col, F.array_sort(F.transform("_hits", lambda x: T.nstruct(
        ord=F.shiftright(x["place"], 32), start=x["place"].bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), n=n(x["gram"]), gram=x["gram"], number=x["number"]))).alias("_spans"))
    per = per.withColumn("_mask", greedy_cover(F.col("_spans")))
    chosen = F.transform(F.filter(F.arrays_zip(F.col("_spans").alias("s"), F.col("_mask").alias("m")),
                                  lambda z: z["m"]), lambda z: T.nstruct(gram=z["s"]["gram"], number=z["s"]["number"]))
    per = per.select(id_col, chosen.alias("_chosen"))
    picked = TK.explode_with_pos(per, id_col, F.array_distinct("_chosen"), "_p", "x")
    if keys is None:
        pv = lookup_vectors(picked.select(id_col, "x.gram"), "gram", vectors, out="_vec", key_col=key_col, vec_col=vec_col)
    else:
        v = vectors.select(F.col("vec_id").cast("long").alias("number"), F.col(vec_col).alias("_vec"))
        pv = picked.select(id_col, "x.number").join(_checked_side(v, VECTOR_ROWS, VECTOR_BYTES), "number")
    means = mean_vectors(pv, id_col, "_vec", out="vec").drop("n_found")
    per = per.select(id_col, F.transform("_chosen", lambda x: x["gram"]).alias("grams"))
    base = df.select(id_col).distinct() if df.columns != [id_col] else df
    return base.join(per.hint("merge"), id_col, "left").join(means.hint("merge"), id_col, "left").select(
        id_col, F.coalesce("grams", F.array().cast("array<string>")).alias("grams"),
        F.coalesce(F.size("grams"), F.lit(0)).alias("n_grams"), "vec")


# ---------------------------------------------------------------------------
# VEC-2 / VEC-3: outlier word and entity reduction
# ---------------------------------------------------------------------------

def outlier_words(df: DataFrame, id_col: str, text_col: str, vectors: DataFrame,
                  key_col: str = "term", vec_col: str = "vec") -> DataFrame:
    """VEC-3: per text, the known word least similar to the mean of the known unit vectors.

    Returns ``(id, outlier, n_known)``; ``outlier`` null when no word is known.
    Ties on similarity go to the smaller word.
    """
    words = TK.explode_with_pos(df, id_col, T.space_split(F.col(text_col)), "pos", "word") \
              .groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    v = vectors.select(F.col(key_col).alias("word"), array_to_vector(normalized(vec_col)).alias("u"))
    known = words.join(checked_broadcast(v), "word")
    # the mean of a text's known words (each as often as it occurs), then each word's similarity to it
    mean = known.groupBy(id_col).agg(Summarizer.mean(F.col("u"), F.col("n").cast("double")).alias("m"), F.sum("n").alias("n_known"))
    sim = F.round(F.aggregate(F.zip_with(vector_to_array("u"), vector_to_array("m"), lambda a, b: a * b), F.lit(0.0),
                              lambda acc, x: acc + x), 9)
    best = known.join(mean, id_col).select(id_col, "n_known", sim.alias("sim"), "word") \
                .groupBy(id_col).agg(F.min(F.struct("sim", "word"))["word"].alias("outlier"), F.first("n_known").alias("n_known"))
    return df.select(id_col).join(best, id_col, "left").select(
        id_col, "outlier", F.coalesce("n_known", F.lit(0)).alias("n_known"))


def reduce_text(words, outlier, max_key_words: int | None = None) -> Column:
    """VEC-2 step on a word array: remove the first occurrence of ``outlier``, else drop the last word.

    With ``max_key_words`` (the most words any vector key has) a text with no
    known word jumps straight to its prefix of that many words: no shorter
    step could match, because segmentation of a prefix only sees grams of
    the text, and no longer prefix is a key.
    """
    ws = T._c(words)
    o = T._c(outlier)
    idx = F.array_position(ws, o)
    removed = T.let(idx, lambda ix: F.array_compact(F.transform(ws, lambda x, i: F.when(i + 1 != ix, x))))
    keep = F.size(ws) - 1 if max_key_words is None else F.least(F.size(ws) - 1, F.lit(max_key_words))
    return (F.when(F.size(ws) <= 1, ws)
             .when(o.isNotNull() & (idx > 0), removed)
             .otherwise(F.slice(ws, 1, keep)))


def reduce_entities(df: DataFrame, id_col: str, text_col: str, vectors: DataFrame, out: str = "reduced",
                    max_key_words: int | None = None, **kw) -> DataFrame:
    """VEC-2 for every text: one reduction step, as a new text column."""
    o = outlier_words(df, id_col, text_col, vectors, **kw)
    j = df.join(o, id_col, "left")
    return j.withColumn(out, F.array_join(reduce_text(T.space_split(F.col(text_col)), F.col("outlier"),
                                                      max_key_words), " "))


# ---------------------------------------------------------------------------
# VEC-1 / VEC-6: resolve entities to vectors
# ---------------------------------------------------------------------------

def _attempt(texts: DataFrame, vectors: DataFrame, idf: DataFrame | None, max_n: int, stopwords, drop_stopwords: bool) -> DataFrame:
    """``texts`` (id, type, text, ...) with ``direct`` (weighted vector of the whole text) and ``mean`` (of its segmentation), null where there is none."""
    d = lookup_vectors(with_weights(texts, "type", "text", idf), "text", vectors, out="_dvec")
    d = d.withColumn("direct", F.when(F.col("_dvec").isNotNull(), scaled("_dvec", "weight"))).drop("_dvec", "weight")
    seg = segment(texts.select("id", "text"), "id", "text", vectors, max_n=max_n, stopwords=stopwords, drop_stopwords=drop_stopwords)
    return d.join(seg.select("id", F.col("vec").alias("mean")), "id", "left")


def reduction_steps(words: list[str], known: dict[str, np.ndarray], max_n: int, max_key_words: int) -> tuple[list[int], list[tuple[int, str, str]]]:
    """(places of the words removed as outliers, in order; the vector keys to try as (step, kind, key)) for one text.

    Step s is the text after s reductions.  Known words go first, each time
    the one least like the mean of those left (VEC-2, VEC-3); then the last
    word goes, step by step.  A step's key is the whole text, if it isn't
    longer than any key (kind ``direct``), and the lower-cased n-grams that
    the removal has made (kind ``segment``; all others were tried before).
    """
    left = list(range(len(words)))
    removed: list[int] = []
    keys: list[tuple[int, str, str]] = []
    names = sorted(set(words) & known.keys())
    if names:
        u = np.stack([known[w] for w in names])
        places = {w: [i for i in left if words[i] == w] for w in names}
        while len(left) > 1 and any(places.values()):
            n = np.array([len(places[w]) for w in names], float)
            sim = np.round(u @ (n @ u / n.sum()), 9)
            at = min((s, w) for s, w, k in zip(sim, names, n) if k)[1]
            cut = left.index(places[at][0])
            removed.append(places[at].pop(0))
            del left[cut]
            step = len(removed)
            if len(left) <= max_key_words:
                keys.append((step, "direct", "_".join(words[i] for i in left)))
            for size in range(2, max_n + 1):
                for start in range(max(0, cut - size + 1), min(cut, len(left) - size + 1)):
                    keys.append((step, "segment", "_".join(words[i].lower() for i in left[start:start + size])))
    for size in range(min(len(left) - 1, max_key_words), 0, -1):
        keys.append((len(removed) + len(left) - size, "direct", "_".join(words[i] for i in left[:size])))
    return removed, keys


def resolve_entities(ents: DataFrame, vectors: DataFrame, idf: DataFrame | None = None,
                     id_col: str = "id", type_col: str = "type", text_col: str = "entity",
                     max_n: int = fixed.MAX_NGRAM, stopwords: list[str] | None = None, drop_stopwords: bool = True) -> DataFrame:
    """Entity -> vector in the original order of attempts.

    (a) direct hit of the whole entity (case kept) times its type weight;
    (b) mean of the segmentation of the lower-cased entity;
    (c) reduce the entity by one word (VEC-2) and retry, until one word is
    left.  All reduced texts of (c) are known at once (`reduction_steps`):
    their keys are looked up in one join and the first step that hits wins,
    so the number of jobs doesn't grow with the texts.  Returns
    ``(id, type, entity, resolved_text, method, vec)`` with ``method`` in
    direct / segment / reduced / none and ``vec`` null for none (Q9).
    """
    ensure_checkpoint_dir(ents.sparkSession)
    # the steps read the weights and the vectors several times: computed once, on shared storage
    vectors = vectors.checkpoint()
    idf = idf.checkpoint() if idf is not None else None
    max_key_words = int(vectors.agg(F.max(F.size(F.split(F.col("term"), "_")))).first()[0] or 1)
    rows = ents.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).alias("_own"), F.col(type_col).alias("type"),
                       F.col(text_col).alias("entity"), F.col(text_col).alias("text")).checkpoint()
    first = _attempt(rows, vectors, idf, max_n, stopwords, drop_stopwords).checkpoint()
    found = F.col("direct").isNotNull() | F.col("mean").isNotNull()

    # (c): the words of the texts without a hit, with the vectors of those that are known as they stand
    rest = first.where(~found).select("id", "_own", "type", "entity", T.space_split("text").alias("words"))
    units = vectors.select(F.col("term").alias("word"), normalized("vec").alias("u"))
    known = TK.explode_with_pos(rest, "id", F.array_distinct("words"), "_p", "word").join(checked_broadcast(units), "word") \
        .groupBy("id").agg(F.collect_list(F.struct("word", "u")).alias("known"))  # words of one text

    def steps(batches):
        for pdf in batches:
            done = [reduction_steps(list(w), {k["word"]: np.asarray(k["u"]) for k in (known if known is not None else [])}, max_n, max_key_words)
                    for w, known in zip(pdf["words"], pdf["known"])]
            yield pd.DataFrame({"id": pdf["id"], "words": pdf["words"], "removed": [r for r, _ in done],
                                "keys": [[{"step": s, "kind": k, "key": x} for s, k, x in keys] for _, keys in done]})

    tried = rest.join(known, "id", "left").select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "known").mapInPandas(
        steps, "id long, words array<string>, removed array<int>, keys array<struct<step:int,kind:string,key:string>>").checkpoint()
    keys = TK.explode_with_pos(tried, "id", "keys", "_p", "k").select("id", "k.step", F.col("k.key").alias("_vkey"))
    best = keys.join(checked_broadcast(vectors.select(F.col("term").alias("_vkey"))), "_vkey", "left_semi").groupBy("id").agg(F.min("step").alias("step"))
    left = F.filter("words", lambda w, i: ~F.array_contains(F.slice("removed", 1, F.least("step", F.size("removed"))), i))
    over = F.greatest(F.col("step") - F.size("removed"), F.lit(0))
    last = F.greatest(F.size("words") - 1, F.lit(0))  # nothing hits: the text is reduced to one word
    texts = tried.join(best, "id", "left").withColumns({"hit": F.col("step").isNotNull(), "step": F.coalesce("step", last)}) \
        .select("id", "hit", T.let(left, lambda w: F.array_join(F.slice(w, 1, F.greatest(F.size(w) - over, F.lit(0))), " ")).alias("text"))
    texts = first.where(~found).select("id", "_own", "type", "entity").join(texts, "id").checkpoint()
    again = _attempt(texts.where("hit"), vectors, idf, max_n, stopwords, drop_stopwords)

    def named(df: DataFrame, method) -> DataFrame:
        return df.select(F.col("_own").alias("id"), "type", "entity", F.col("text").alias("resolved_text"), method.alias("method"), F.coalesce("direct", "mean").alias("vec"))

    none = F.lit(None).cast("array<double>")
    return named(first.where(found), F.when(F.col("direct").isNotNull(), "direct").otherwise("segment")) \
        .unionByName(named(again, F.lit("reduced"))) \
        .unionByName(named(texts.where("not hit").withColumns({"direct": none, "mean": none}), F.lit("none")))
