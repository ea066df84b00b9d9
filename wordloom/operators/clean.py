"""Phrase substitution (CLN-2 / JOIN-2) and spelling correction (CLN-5 / JOIN-5 / JOIN-7).

Both are joins, not per-row dictionaries:

* phrases - runs of units (words and single other characters) as long as a
  phrase are looked up in the phrase table within the row; the matches of one
  text are resolved by a greedy longest-first cover and the text is rebuilt in-row.
* spelling - only the *distinct vocabulary* is corrected: unknown words are
  found with an anti-join, candidates come from an equi-join on shared
  deletion keys of the words' first letters, are verified by edit distance
  and ranked by (distance, frequency).  The corrections are then looked up
  within the rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import tokens as TK
from wordloom.operators.cover import greedy_cover
from wordloom.operators.lookup import bounded_rows, with_entries, with_lookup
from wordloom.session import checked_broadcast, stage_path

# units of a text for phrase matching: runs of word characters, and every other character by itself
UNITS = r"\w+|\W"


# ---------------------------------------------------------------------------
# SRC-5 + built-ins: the phrase table
# ---------------------------------------------------------------------------

def synonym_table(spark, entries: list[tuple[str, str]] | None = None, file_df: DataFrame | None = None,
                  with_builtins: bool = True, case_sensitive: bool = False) -> DataFrame:
    """``(phrase, target, n_chars, rank)`` ordered by ``rank`` (longest phrase first).

    ``file_df`` is a parsed synonym file ``(line_no, phrase, target)`` or
    ``(file, line_no, phrase, target)`` (see ``sources.readers.read_synonyms``)
    and comes first; then ``entries``, then the built-in map.  A phrase given twice keeps its first position and
    its last target.  Matching is case-insensitive unless ``case_sensitive``.
    """
    rows = [(1, i, p, t) for i, (p, t) in enumerate(entries or [])]
    if with_builtins:
        rows += [(2, i, p, t) for i, (p, t) in enumerate(fixed.BUILTIN_SYNONYMS)]
    order = F.struct("source", "file", "line")
    df = spark.createDataFrame(rows, "source int, line long, phrase string, target string").withColumn("file", F.lit(""))
    if file_df is not None:
        name = F.col("file") if "file" in file_df.columns else F.lit("")
        df = df.unionByName(file_df.select(F.lit(0).alias("source"), name.alias("file"), F.col("line_no").cast("long").alias("line"),
                                           "phrase", "target"))
    key = F.trim(F.regexp_replace(F.col("phrase"), r"\s+", " "))
    if not case_sensitive:
        key = F.lower(key)
    df = df.select(key.alias("phrase"), "target", order.alias("place")).where(F.col("phrase") != "")
    df = df.groupBy("phrase").agg(F.min("place").alias("place"), F.max_by("target", "place").alias("target"))
    return df.select("phrase", "target", F.length("phrase").alias("n_chars"), F.size(units("phrase")).alias("n_units"), "place")


def units(text) -> Column:
    """Words and single other characters of a text, in order; joined they give the text back."""
    return F.regexp_extract_all(T._c(text), F.lit(UNITS), F.lit(0))


FIRST_WORDS_LITERAL_MAX = 10_000


def _candidate_spans(text, phrases: DataFrame, lengths: list[int]) -> Column:
    """``array<struct<n, start, gram>>``: the runs of a text's units that can be a phrase.

    With a small phrase table (checked) runs are made only where a unit can
    start a phrase, and as long as phrases from it (literal hash-set tests);
    otherwise every run as long as some phrase.
    """
    firsts = phrases.select(F.get(units("phrase"), 0).alias("w"), "n_units").distinct().limit(FIRST_WORDS_LITERAL_MAX + 1).collect()
    few = len(firsts) <= FIRST_WORDS_LITERAL_MAX
    first_set = {r["w"] for r in firsts}
    by_length = {n: {r["w"] for r in firsts if r["n_units"] == n} for n in lengths}

    def spans(k):
        size = F.size(k)
        starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        if few:
            starts = F.filter(starts, lambda i: F.get(k, i).isin(*first_set))

        def fitting(i):
            """The lengths that a phrase from here may have."""
            here = lambda n: (i + n <= size) & F.get(k, i).isin(*by_length[n]) if few else i + n <= size
            return F.array_compact(F.array(*[F.when(here(n), F.lit(n)) for n in lengths]))
        return F.flatten(F.transform(starts, lambda i: F.transform(
            fitting(i), lambda n: T.nstruct(n=n, start=i, gram=F.array_join(F.slice(k, i + 1, n), "")))))

    return T.let(units(text), spans)


class PhraseTable:
    """The substitution of `replace_phrases` in one text, by a phrase table of bounded size."""

    def __init__(self, phrases: list):
        given = lambda v: (v is not None, v)  # noqa: E731  null first
        order = lambda r: (-r["n_chars"], *map(given, r["place"]))
        self.rank = {k: i for i, k in enumerate(sorted({order(r) for r in phrases}))}
        self.found = {r["phrase"]: (self.rank[order(r)], r["n_units"], r["target"]) for r in phrases}
        self.lengths: dict[str, list[int]] = {}
        for phrase, (_, n, _) in self.found.items():
            here = self.lengths.setdefault(re.search(UNITS, phrase, re.ASCII)[0], [])
            if n not in here:
                here.append(n)

    def __call__(self, text: str | None, lowered: str | None) -> str | None:
        if text is None:
            return None
        keys = re.findall(UNITS, lowered, re.ASCII)
        hits = []
        for i in [i for i, u in enumerate(keys) if u in self.lengths]:
            for n in self.lengths[keys[i]]:
                if n == 1 or i + n <= len(keys):
                    v = self.found.get(keys[i] if n == 1 else "".join(keys[i:i + n]))
                    if v is not None:
                        hits.append((v[0], i, n, v[2]))
        if not hits:
            return text
        hits.sort(key=lambda h: (*h[:3], h[3] is not None, h[3] or ""))
        covered, taken = set(), []
        for _, i, n, target in hits:
            own = range(i, i + n)
            if covered.isdisjoint(own):
                covered.update(own)
                taken.append((i, n, target))
        taken.sort(key=lambda x: x[0])
        words = keys if text == lowered else re.findall(UNITS, text, re.ASCII)
        pieces, end = [], 0
        for i, n, target in taken:
            pieces += words[end:i]
            pieces.append(target if target is not None else "".join(words[i:i + 1]))
            end = i + n
        return "".join(pieces + words[end:])


def replace_phrases(df: DataFrame, id_col: str, text_col: str, phrases: DataFrame,
                    out: str = "cleaned", case_sensitive: bool = False) -> DataFrame:
    """CLN-2 + CLN-3: whole-word phrase substitution, longest phrase first.

    A phrase matches a run of units, so an edge of it that is a word
    character lies at a word boundary and any other edge may lie anywhere
    (``(bedrm)``, ``a--b``).  Phrases are applied in (length desc, table
    order) order and replaced text is never matched again, which is the
    same as replacing phrase by phrase with a shield.  With a phrase table of
    bounded size texts are worked on by Arrow batch (`PhraseTable`), with a
    larger one phrases are looked up by `lookup`; a text is put together piece
    by piece, so its cost grows with its length.
    """
    squeezed = T.squeeze_spaces(F.col(text_col))
    if bounded_rows(phrases.select(F.col("phrase").alias("key"), F.struct("target", "place").alias("value"))) is not None:
        substitute = PhraseTable(phrases.collect())  # checked above

        def substituted(texts: pa.Array, lowered: pa.Array) -> pa.Array:
            return pa.array(map(substitute, texts.to_pylist(), lowered.to_pylist()), pa.string())

        done = F.arrow_udf(substituted, "string")(squeezed, squeezed if case_sensitive else F.lower(squeezed))
        return df.withColumn("_s", done).select(*df.columns, F.trim(T.squeeze_spaces(F.col("_s"))).alias(out))
    lengths = sorted(r[0] for r in phrases.select("n_units").distinct().collect())  # distinct lengths: a few numbers
    # a target goes behind a mark, which tells an empty one from none
    place = F.col("place")
    table = phrases.select(F.col("phrase").alias("key"), F.struct(
        F.concat(F.lit("="), "target").alias("target"), (-F.col("n_chars")).alias("o1"),
        *[place[c].alias(f"p_{c}") for c in phrases.schema["place"].dataType.names]).alias("value"))
    order = ["o1", *[f"p_{c}" for c in phrases.schema["place"].dataType.names]]
    base = df.withColumn("_spans", _candidate_spans(squeezed if case_sensitive else F.lower(squeezed), phrases, lengths or [1]))

    def hits(find):
        def hit(s):
            return T.let(find(s["gram"]), lambda v: F.when(v.isNotNull(), T.nstruct(
                **{c: v[c] for c in order}, start=s["start"], n=s["n"], target=v["target"])))
        return F.array_sort(F.filter(F.transform("_spans", hit), lambda h: h.isNotNull()))

    j = with_lookup(base, F.transform("_spans", lambda s: s["gram"]), table, hits, "_s").drop("_spans")
    j = j.withColumn("_m", greedy_cover(F.col("_s")))
    taken = F.array_sort(F.transform(F.filter(F.arrays_zip(F.col("_s").alias("s"), F.col("_m").alias("m")), lambda z: z["m"]),
                                     lambda z: T.nstruct(start=z["s"]["start"], n=z["s"]["n"], target=F.substring(z["s"]["target"], 2, 1 << 30))))

    def rebuild(w, c):
        end = lambda i: F.when(i > 0, F.get(c, i - 1)["start"] + F.get(c, i - 1)["n"]).otherwise(F.lit(0))
        between = lambda a, b: F.array_join(F.slice(w, a + 1, b - a), "")
        pieces = F.transform(c, lambda x, i: F.concat(between(end(i), x["start"]), F.coalesce(x["target"], F.get(w, x["start"]))))
        return F.concat(F.array_join(pieces, ""), between(end(F.size(c)), F.size(w)))

    cleaned = T.let(units(squeezed), lambda w: T.let(taken, lambda c: rebuild(w, c)))
    return j.select(*df.columns, F.trim(T.squeeze_spaces(cleaned)).alias(out))


# ---------------------------------------------------------------------------
# CLN-4 / CLN-5 / JOIN-5 / JOIN-7: spelling
# ---------------------------------------------------------------------------

def spell_words(text) -> Column:
    """CLN-4 + CLN-3 + TOK-3: pad punctuation, collapse blanks, split on blanks."""
    return T.space_split(T.squeeze_spaces(T.pad_punctuation(T._c(text))))


def eligible(word) -> Column:
    """Words worth checking: a word character and no digit."""
    w = T._c(word)
    return w.rlike(r"\w") & ~w.rlike(r"[0-9]")


def deletes(word, d: int) -> Column:
    """All strings from deleting up to ``d`` characters (the word itself included)."""
    def one(w):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                           lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    lvl = F.array(T._c(word))
    out = lvl
    for _ in range(d):
        lvl = F.array_distinct(F.flatten(F.transform(lvl, one)))
        out = F.concat(out, lvl)
    return F.array_distinct(out)


# Letters of a word from which candidates' letters are deleted.
SPELL_PREFIX = 7


def deletion_keys(word, max_distance: int, prefix: int = SPELL_PREFIX) -> Column:
    """Hashes of the word's first ``prefix`` letters with up to ``max_distance`` of them deleted.

    Words within the distance share a key: delete on either side the letters
    that the edits touch within the prefix, and from the end of the longer
    rest until both have one length.  That takes no more deletions than there
    are edits, so the keys of a word are bounded, however long it is.
    """
    if prefix <= max_distance:
        raise ValueError("the prefix must be longer than the distance")
    return F.array_distinct(F.transform(deletes(F.substring(T._c(word), 1, prefix), max_distance), lambda k: F.xxhash64(k)))


def single_swap(a, b) -> Column:
    """True when ``b`` is ``a`` with exactly one pair of adjacent characters swapped."""
    a, b = T._c(a), T._c(b)
    n = F.length(a)
    one = F.lit(1)
    diff = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: F.substr(a, i, one) != F.substr(b, i, one))
    return T.let(diff, lambda df_: (F.length(b) == n) & (F.size(df_) == 2)
                 & (F.get(df_, 1) == F.get(df_, 0) + 1)
                 & (F.substr(a, F.get(df_, 0), one) == F.substr(b, F.get(df_, 1), one))
                 & (F.substr(a, F.get(df_, 1), one) == F.substr(b, F.get(df_, 0), one)))


def letters(word) -> Column:
    """The word's characters in order, as one string: a swap doesn't change it."""
    return F.array_join(F.array_sort(F.split(T._c(word), "")), "")


def edit_distance(a, b, max_d: int, letters_a=None, letters_b=None) -> Column:
    """Edit distance up to ``max_d`` <= 2 (null above) where swapping two adjacent characters is one edit.

    ``letters_a`` and ``letters_b`` are `letters` of the words where they are known already.
    """
    if max_d > 2:
        raise ValueError("distances above 2 are not supported")
    a, b = T._c(a), T._c(b)
    lev = F.levenshtein(a, b, 2)
    d = F.when((lev == 0) | (lev == 1), lev).when((lev == 2) & single_swap(a, b), F.lit(1))
    if max_d > 1:
        # Two edits of which one is a swap: it comes first (a swap of a) or last (a swap of b).
        places = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1)))
        one = F.lit(1)

        def swapped(w, i):
            return F.concat(F.substr(w, one, i - 1), F.substr(w, i + 1, one), F.substr(w, i, one), F.substr(w, i + 2))

        near = lambda x, y: F.levenshtein(x, y, 1) >= 0
        with_swap = F.exists(places(a), lambda i: near(swapped(a, i), b) | single_swap(swapped(a, i), b)) \
            | F.exists(places(b), lambda i: near(a, swapped(b, i)))
        # a swap and an edit leave the same letters but for that edit's
        alike = F.levenshtein(letters(a) if letters_a is None else T._c(letters_a), letters(b) if letters_b is None else T._c(letters_b), 2) >= 0
        d = d.when(lev == 2, lev).when((F.abs(F.length(a) - F.length(b)) <= 1) & alike & with_swap, F.lit(2))
    return d


def spell_candidates(words: DataFrame, dictionary: DataFrame, max_distance: int = 2,
                     word_col: str = "word") -> DataFrame:
    """JOIN-5: best dictionary word for every unknown eligible word.

    ``words``: distinct words to check; ``dictionary``: ``(word, freq)``.
    Returns ``(word, correction, distance, freq)`` for the words that have a
    candidate; ranking is distance asc, frequency desc, word asc.
    """
    vocab = words.select(F.col(word_col).alias("word")).where(eligible("word")).distinct()
    dic = dictionary.select(F.col("word").alias("cand"), F.col("freq").cast("long").alias("freq"))
    unknown = vocab.join(dic.select(F.col("cand").alias("word")), "word", "left_anti")  # JOIN-7
    # few words, but each is much work
    unknown = unknown.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    uk = TK.explode_with_pos(unknown.withColumn("_lw", letters("word")), ["word", "_lw"], deletion_keys("word", max_distance), "_p", "dkey")
    dk = TK.explode_with_pos(dic.withColumn("_lc", letters("cand")), ["cand", "freq", "_lc"], deletion_keys("cand", max_distance), "_p", "dkey")
    # Most pairs are decided before they are shuffled.  A swap is two plain edits; a word with a swap and another edit has the other's
    # letters but for that edit, one with swaps only has its letters.
    gap, lev = F.abs(F.length("word") - F.length("cand")), lambda d: F.levenshtein("word", "cand", d)
    swaps = (gap < max_distance) & (F.levenshtein("_lw", "_lc", 2 * max_distance - 2) >= 0) & ((F.col("_lw") == F.col("_lc")) | (lev(2 * max_distance - 1) >= 0)) \
        & (lev(2 * max_distance) >= 0)
    near = (gap <= max_distance) & ((lev(max_distance) >= 0) | swaps)
    pairs = uk.drop("_p").join(checked_broadcast(dk.drop("_p")), "dkey").where(near).select("word", "cand", "freq", "_lw", "_lc").distinct()
    from wordloom.operators.labels import keep_rows
    scored = keep_rows(pairs.withColumn("distance", edit_distance("word", "cand", max_distance, "_lw", "_lc")),
                       F.col("distance").isNotNull())
    best = scored.groupBy("word").agg(F.min(F.struct("distance", (-F.col("freq")).alias("nf"), "cand")).alias("b"))
    return best.select("word", F.col("b.cand").alias("correction"), F.col("b.distance").cast("int").alias("distance"),
                       (-F.col("b.nf")).alias("freq"))


def spell_correct(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, max_distance: int = 2,
                  out: str = "corrected") -> DataFrame:
    """CLN-5: correct every eligible unknown word of every text; other words pass through.

    Returns ``(id, out, n_words, n_corrected)``, a row for every row.  Each
    distinct word is corrected once; a text meets the corrections of its own
    words (see `lookup.with_entries`) and is put together by Arrow batch.
    """
    base = df.select(id_col, F.col(text_col).alias("_t"))
    checked = F.filter(F.array_distinct(spell_words("_t")), eligible)
    words = TK.explode_with_pos(base, [], checked, "_p", "word").select("word").distinct()
    path = stage_path(df.sparkSession, "corrections")
    spell_candidates(words, dictionary, max_distance).select(F.col("word").alias("key"), F.col("correction").alias("value")).write.parquet(path)
    corr = df.sparkSession.read.parquet(path)

    def corrected(texts: pa.Array, known: pa.Array) -> pa.Array:
        found, ends = known.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False))
        keys, values = found.field("key").to_pylist(), found.field("value").to_pylist()
        rows, at = [], 0
        for t, end in zip(texts.to_pylist(), ends.tolist()):
            own, at = dict(zip(keys[at:end], values[at:end])), end
            words = t.split(" ") if t else []
            rows.append((" ".join([own.get(w, w) for w in words]) if own else t or "", len(words), sum(map(own.__contains__, words)) if own else 0))
        columns = [*zip(*rows)] or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["text", "words", "corrected"])

    # corrections grow with the texts: joined at every size
    done = with_entries(base, checked, corr, text=F.col("_t"))
    spaced = F.trim(T.squeeze_spaces(T.pad_punctuation("_t")))  # the words of `spell_words`, a blank between them
    known = F.coalesce("_known", F.array().cast("array<struct<key:string,value:string>>"))
    done = done.withColumn("_c", F.arrow_udf(corrected, "text: string, words: long, corrected: long")(spaced, known))
    return done.select(id_col, F.col("_c.text").alias(out), F.col("_c.words").alias("n_words"), F.col("_c.corrected").alias("n_corrected"))


def preclean(df: DataFrame, id_col: str, text_col: str, phrases: DataFrame, dictionary: DataFrame,
             max_distance: int = 2, out: str = "cleaned") -> DataFrame:
    """CLN-6: phrases first, then spelling."""
    p = replace_phrases(df.select(id_col, text_col), id_col, text_col, phrases, out="_p")
    s = spell_correct(p.select(id_col, "_p"), id_col, "_p", dictionary, max_distance, out=out)
    return df.join(s.select(id_col, out), id_col, "left")
