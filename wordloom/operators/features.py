"""Token feature records (FEA-10..12) and the dictionary lookups behind them (JOIN-3, JOIN-4).

Tokens stay one array per text while features are built, so the whole
feature step is a projection: no explode, no shuffle.  Lookups against the
fixed gazetteers compile to hash-set membership tests (``InSet``); a
caller's lexicon or gazetteer is looked up within the row while it has a
bounded size, and joined with the texts' distinct words beyond it (see
`lookup`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import shape as S
from wordloom.functions import text as T
from wordloom.operators.lookup import with_lookup
from wordloom.session import checked_broadcast


def gazetteer_table(spark) -> DataFrame:
    """D16: the fixed gazetteers as a small ``(kind, term)`` table."""
    rows = ([("location", t) for t in dict.fromkeys(fixed.LOCATIONS)]
            + [("object", t) for t in dict.fromkeys(fixed.OBJECTS)]
            + [("preposition", t) for t in fixed.PREPOSITIONS])
    return spark.createDataFrame(rows, "kind string, term string")


def is_location(t) -> Column:
    """JOIN-3: raw token longer than two characters listed as a location (case-sensitive)."""
    t = T._c(t)
    return (F.length(t) >= fixed.GAZETTEER_MIN_LENGTH) & t.isin(*dict.fromkeys(fixed.LOCATIONS))


def is_object(t) -> Column:
    t = T._c(t)
    return (F.length(t) >= fixed.GAZETTEER_MIN_LENGTH) & t.isin(*dict.fromkeys(fixed.OBJECTS))


def is_preposition(t) -> Column:
    return T.abbrev_token(t).isin(*fixed.PREPOSITIONS)


def gazetteer_flags(df: DataFrame, token_col: str = "token", gazetteer: DataFrame | None = None) -> DataFrame:
    """Add ``is_location``, ``is_object``, ``prepositions`` booleans.

    Without ``gazetteer`` the fixed lists are used as literal sets.  With a
    ``(kind, term)`` table the distinct tokens are joined once against it
    (broadcast only below the checked size) and the flags joined back.
    """
    if gazetteer is None:
        t = F.col(token_col)
        return df.withColumns({"is_location": is_location(t), "is_object": is_object(t),
                               "prepositions": is_preposition(t)})
    g = gazetteer.groupBy("term").agg(
        F.max((F.col("kind") == "location").cast("int")).alias("_loc"),
        F.max((F.col("kind") == "object").cast("int")).alias("_obj"),
        F.max((F.col("kind") == "preposition").cast("int")).alias("_pre"))
    vocab = df.select(F.col(token_col).alias("_tok")).distinct().withColumn("_abbr", T.abbrev_token("_tok"))
    gb = checked_broadcast(g)
    flags = (vocab.join(gb.select(F.col("term").alias("_tok"), "_loc", "_obj"), "_tok", "left")
                  .join(gb.select(F.col("term").alias("_abbr"), "_pre"), "_abbr", "left")
                  .select("_tok",
                          ((F.length("_tok") >= fixed.GAZETTEER_MIN_LENGTH) & (F.coalesce("_loc", F.lit(0)) == 1)).alias("is_location"),
                          ((F.length("_tok") >= fixed.GAZETTEER_MIN_LENGTH) & (F.coalesce("_obj", F.lit(0)) == 1)).alias("is_object"),
                          (F.coalesce("_pre", F.lit(0)) == 1).alias("prepositions")))
    return df.join(flags, df[token_col] == flags["_tok"], "left").drop("_tok")


def pos_lookup(lexicon: DataFrame, default_tag: str = "") -> DataFrame:
    """JOIN-4 side table ``(word, nouns_count, verbs_count, nltk_tag)`` from a ``(word, tag[, ord])`` lexicon.

    Noun tags start with NN, verb tags with VB; the tag kept is the last one
    by ``ord`` when present, else the greatest tag.
    """
    tag_pick = F.max_by("tag", "ord") if "ord" in lexicon.columns else F.max("tag")
    return (lexicon.groupBy("word")
                   .agg(F.sum(F.col("tag").startswith("NN").cast("int")).alias("nouns_count"),
                        F.sum(F.col("tag").startswith("VB").cast("int")).alias("verbs_count"),
                        tag_pick.alias("nltk_tag")))


def with_pos(df: DataFrame, token_col: str, lexicon: DataFrame | None, default_tag: str = "") -> DataFrame:
    """Left-join the POS counts on the raw token; unknown words get 0, 0, ``default_tag``."""
    if lexicon is None:
        return df.withColumns({"nouns_count": F.lit(0), "verbs_count": F.lit(0), "nltk_tag": F.lit(default_tag)})
    lk = checked_broadcast(pos_lookup(lexicon).withColumnRenamed("word", "_w"))
    out = df.join(lk, df[token_col] == lk["_w"], "left").drop("_w")
    return out.withColumns({"nouns_count": F.coalesce("nouns_count", F.lit(0)).cast("int"),
                            "verbs_count": F.coalesce("verbs_count", F.lit(0)).cast("int"),
                            "nltk_tag": F.coalesce("nltk_tag", F.lit(default_tag))})


def word_table(lexicon: DataFrame | None, gazetteer: DataFrame | None) -> DataFrame:
    """(key, value struct<nouns, verbs, tag, location, object>): what the lexicon and the gazetteer say of a word, null where they don't."""
    parts = []
    if lexicon is not None:
        parts.append(pos_lookup(lexicon).select(F.col("word").alias("key"), F.col("nouns_count").cast("int").alias("nouns"), F.col("verbs_count").cast("int").alias("verbs"),
                                                F.col("nltk_tag").alias("tag"), F.lit(None).cast("boolean").alias("location"), F.lit(None).cast("boolean").alias("object")))
    if gazetteer is not None:
        long = F.length("term") >= fixed.GAZETTEER_MIN_LENGTH
        parts.append(gazetteer.where(F.col("kind").isin("location", "object")).groupBy(F.col("term").alias("key")).agg(
            F.lit(None).cast("int").alias("nouns"), F.lit(None).cast("int").alias("verbs"), F.lit(None).cast("string").alias("tag"),
            F.max(long & (F.col("kind") == "location")).alias("location"), F.max(long & (F.col("kind") == "object")).alias("object")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fields = ["nouns", "verbs", "tag", "location", "object"]
    return both.where("key is not null").groupBy("key").agg(*[F.max(f).alias(f) for f in fields]).select("key", F.struct(*fields).alias("value"))


def with_pos_array(df: DataFrame, tokens_col: str, lexicon: DataFrame | None = None, gazetteer: DataFrame | None = None,
                   out: str = "pos", default_tag: str = "") -> DataFrame:
    """JOIN-3 / JOIN-4 for whole texts: an array of lookup results beside the token array, in token order.

    ``lexicon`` (word, tag[, ord]) gives the POS fields, ``gazetteer``
    (kind, term) the location and object flags; without a gazetteer the
    fixed lists do.  The words are looked up within the row (see
    `lookup.with_lookup`), so tables of bounded size work on a stream too.
    """
    tk = F.col(tokens_col)

    def entry(t, found):
        return T.nstruct(nouns_count=F.coalesce(found["nouns"], F.lit(0)), verbs_count=F.coalesce(found["verbs"], F.lit(0)),
                         nltk_tag=F.coalesce(found["tag"], F.lit(default_tag)),
                         is_location=F.coalesce(found["location"], F.lit(False)) if gazetteer is not None else is_location(t),
                         is_object=F.coalesce(found["object"], F.lit(False)) if gazetteer is not None else is_object(t))

    if lexicon is None and gazetteer is None:
        nothing = F.lit(None).cast("struct<nouns:int,verbs:int,tag:string,location:boolean,object:boolean>")
        return df.withColumn(out, F.transform(F.coalesce(tk, F.array().cast("array<string>")), lambda t: entry(t, nothing)))
    return with_lookup(df, tk, word_table(lexicon, gazetteer), lambda find: F.transform(
        F.coalesce(tk, F.array().cast("array<string>")), lambda t: T.let(find(t), lambda found: entry(t, found))), out)


def token_record(t, nouns=None, verbs=None, tag=None, location=None, object_=None, optional=()) -> Column:
    """FEA-10: one token's feature struct (looked-up fields from columns when given).

    ``optional`` names features of ``shape.OPTIONAL_FEATURES`` to add (FEA-9).

    The cleaned and abbreviated forms are bound once per token and shared by
    the features that need them.
    """
    t = T._c(t)

    def build(cl, ab):
        return T.nstruct(
            nouns_count=(nouns if nouns is not None else F.lit(0)).cast("int"),
            verbs_count=(verbs if verbs is not None else F.lit(0)).cast("int"),
            nltk_tag=(tag if tag is not None else F.lit("")),
            is_location=location if location is not None else is_location(t),
            is_object=object_ if object_ is not None else is_object(t),
            length=S.token_length(t).cast("int"),
            has_vowels=F.substring(ab, 2, 1 << 30).rlike(f"[{fixed.VOWELS}]"),
            period=S.has_period(t),
            comma=S.ends_with_comma(t),
            prepositions=ab.isin(*fixed.PREPOSITIONS),
            possessive=cl.endswith("'s"),
            **{name.replace(".", "_"): S.OPTIONAL_FEATURES[name](t) for name in optional},
        )

    return T.let(T.clean_token(t), lambda cl: T.let(
        F.when(t.isin("&"), t).otherwise(F.regexp_replace(cl, r"\W", "")), lambda ab: build(cl, ab)))


def token_records(tokens, pos=None, optional=()) -> Column:
    """FEA-10 for a token array: ``array<struct<f, rawstring_start, rawstring_end>>`` (arguments as in `sequence_features`)."""
    tk = T._c(tokens)
    n = F.size(tk)

    def base(x, i, found=None):
        own = F.get(found, i) if found is not None else None
        rec = token_record(x, *([own[c] for c in ("nouns_count", "verbs_count", "nltk_tag", "is_location", "is_object")] if own is not None else []),
                           optional=optional)
        return T.nstruct(f=rec, rawstring_start=(i == 0) & (n > 1), rawstring_end=(i == n - 1) & (n > 1))

    # the lookups are bound once a row: within the lambda they would be made again for every token
    return F.transform(tk, lambda x, i: base(x, i)) if pos is None else T.let(pos, lambda found: F.transform(tk, lambda x, i: base(x, i, found)))


def sequence_features(tokens, pos=None, optional=()) -> Column:
    """FEA-10..12 over a token array, in place (no explode).

    Returns ``array<struct<token, feat, rawstring_start, rawstring_end,
    singleton, previous, next>>`` where ``previous``/``next`` are the
    neighbours' feature structs including their own boundary flags, null at
    the edges.  ``pos`` (an array beside the tokens, see `with_pos_array`)
    supplies the looked-up fields when given; ``optional`` adds FEA-9 features.
    """
    tk = T._c(tokens)
    return T.let(token_records(tokens, pos, optional), lambda rs: F.transform(rs, lambda r, i: T.nstruct(
        token=F.get(tk, i),
        feat=r["f"],
        rawstring_start=r["rawstring_start"],
        rawstring_end=r["rawstring_end"],
        singleton=F.size(rs) == 1,
        previous=F.get(rs, i - 1),
        next=F.get(rs, i + 1),
    )))


def explode_features(df: DataFrame, id_cols, feats_col: str = "features") -> DataFrame:
    """Long form of ``sequence_features``: one row per token with flat neighbour columns."""
    from wordloom.operators.tokens import explode_with_pos
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return explode_with_pos(df, ids, feats_col, "pos", "r").select(*ids, "pos", "r.*")
