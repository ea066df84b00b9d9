"""Scalar string functions (Column -> Column), all JVM-side expressions.

Every function accepts a column name or a Column and returns a Column, so
it composes inside ``select``/``withColumn`` and stays in whole-stage
codegen.  Regexes are kept free of look-around so the same pattern also
runs on RE2-based engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom import fixed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(expr, fn) -> Column:
    """Evaluate ``expr`` once per row and pass it to ``fn`` as a lambda variable.

    Inside a higher-order-function lambda every non-variable subexpression is
    re-evaluated for each element; binding it first keeps per-row work linear.
    """
    return F.get(F.transform(F.array(_c(expr)), fn), 0)


def nstruct(**fields) -> Column:
    """``named_struct`` from keyword arguments (no aliases, safe inside any lambda)."""
    args = []
    for k, v in fields.items():
        args += [F.lit(k.replace("__", ".")), v]
    return F.named_struct(*args)


def ascii_only(c) -> Column:
    """CLN-1: null -> '' and drop every non-ASCII character."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^\x00-\x7F]", "")


def squeeze_spaces(c) -> Column:
    """CLN-3: runs of white space become one blank."""
    return F.regexp_replace(_c(c), r"\s+", " ")


def pad_punctuation(c) -> Column:
    """CLN-4: blanks around quote, slash, colon, brackets, period, comma, apostrophe, backslash."""
    return F.regexp_replace(_c(c), fixed.PAD_PUNCTUATION_PATTERN, " $1 ")


def normalize(c) -> Column:
    """CLN-1 + CLN-8 + CLN-3: ASCII, lower case, single blanks, trimmed."""
    return F.trim(squeeze_spaces(F.lower(ascii_only(c))))


def decode_utf8(c) -> Column:
    """CLN-10: bytes -> text; malformed bytes become U+FFFD.  Strings pass through unchanged."""
    return F.make_valid_utf8(_c(c).cast("string"))


def fix_labels(c, fixes=fixed.TRAINING_LABEL_FIXES) -> Column:
    """CLN-9: substring patches of known label typos."""
    out = _c(c)
    for bad, good in fixes:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def split_digit_letter(c) -> Column:
    """TOK-1: '13cb' -> '13 cb' (digit then letter only)."""
    return F.regexp_replace(_c(c), r"([0-9])([a-zA-Z])", "$1 $2")


def tokenize(c, pattern: str = fixed.TOKEN_PATTERN) -> Column:
    """TOK-2: array of tokens; empty or null text gives an empty array."""
    return F.regexp_extract_all(split_digit_letter(F.coalesce(_c(c), F.lit(""))),
                                F.lit(pattern), 0)


def space_split(c) -> Column:
    """TOK-3: blank-separated words of trimmed text; empty text -> []."""
    t = F.trim(_c(c))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def idf_terms(c) -> Column:
    """TOK-4: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"\b\w\w+\b"), 0)


def vector_key(c) -> Column:
    """TOK-7: blanks become underscores (multi-word vector keys)."""
    return F.replace(_c(c), F.lit(" "), F.lit("_"))


def clean_token(t) -> Column:
    """TOK-8: lower, strip leading non-word and trailing non-[.\\w]; '&' kept."""
    t = _c(t)
    stripped = F.regexp_replace(F.lower(t), r"^\W*|[^.\w]*$", "")
    return F.when(t.isin("&"), t).otherwise(stripped)


def abbrev_token(t) -> Column:
    """TOK-9: cleaned token without non-word characters."""
    t = _c(t)
    return F.when(t.isin("&"), t).otherwise(F.regexp_replace(clean_token(t), r"\W", ""))
