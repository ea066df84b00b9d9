"""Token shape features FEA-1..FEA-9 as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions.text import _c, abbrev_token, clean_token


def token_length(t) -> Column:
    """FEA-1: raw token length."""
    return F.length(_c(t))


def has_vowels(t) -> Column:
    """FEA-2: a vowel (y included) after the first character of the abbreviated token."""
    return F.substring(abbrev_token(t), 2, 1 << 30).rlike(f"[{fixed.VOWELS}]")


def has_period(t) -> Column:
    """FEA-3: the token contains a literal period."""
    return F.instr(_c(t), ".") > 0


def ends_with_comma(t) -> Column:
    """FEA-4: raw token ends with a comma."""
    return _c(t).endswith(",")


def possessive(t) -> Column:
    """FEA-5: cleaned token ends with 's."""
    return clean_token(t).endswith("'s")


def trailing_zeros(t) -> Column:
    """FEA-6: trailing run of zeros, '' if none."""
    return F.regexp_extract(_c(t), r"(0+)$", 1)


def digits(t) -> Column:
    """FEA-7: all_digits / some_digits / no_digits."""
    t = _c(t)
    return (F.when(t.rlike(r"^[0-9]+$"), "all_digits")
            .when(t.rlike(r"[0-9]"), "some_digits")
            .otherwise("no_digits"))


def casing(t) -> Column:
    """FEA-8: upper / lower / title / mixed / false (ASCII letters)."""
    t = _c(t)
    return (F.when(t.rlike(r"^[^a-z]*[A-Z][^a-z]*$"), "upper")
            .when(t.rlike(r"^[^A-Z]*[a-z][^A-Z]*$"), "lower")
            .when(t.rlike(r"^[^A-Za-z]*[A-Z][a-z]*([^A-Za-z]+[A-Z][a-z]*)*[^A-Za-z]*$"), "title")
            .when(t.rlike(r"^[A-Za-z]+$"), "mixed")
            .otherwise("false"))


# FEA-9: optional shape features, one expression each.
def hyphenated(t) -> Column:
    return F.instr(clean_token(t), "-") > 0


def contracted(t) -> Column:
    return F.instr(clean_token(t), "'") > 0


def just_letters(t) -> Column:
    return abbrev_token(t).rlike(r"^[A-Za-z]+$")


def initial(t) -> Column:
    return abbrev_token(t).rlike(r"^[A-Za-z]$")


def ends_with_vowel(t) -> Column:
    return abbrev_token(t).rlike(f"[{fixed.VOWELS}]$")


def roman(t) -> Column:
    return abbrev_token(t).rlike(r"^[xvi]*$")


def abbreviation(t) -> Column:
    return clean_token(t).endswith(".")


def length_code(t) -> Column:
    a = abbrev_token(t)
    return F.when(a.rlike(r"^[0-9]+$"), F.concat(F.lit("d:"), F.length(a).cast("string"))) \
            .otherwise(F.concat(F.lit("w:"), F.length(a).cast("string")))


def full_bracketed(t) -> Column:
    return _c(t).rlike(r"""^["('][A-Za-z0-9_]+[")']""")


def bracketed(t) -> Column:
    """A bracket or quote at one side of the leading word only."""
    return _c(t).rlike(r"""^(["('][A-Za-z0-9_]+|[A-Za-z0-9_]+[")'])""") & ~full_bracketed(t)


def more_vowels(t) -> Column:
    """More vowels than other characters."""
    a = abbrev_token(t)
    return F.length(F.regexp_replace(a, f"[^{fixed.VOWELS}]", "")) * 2 > F.length(a)


def ends_in_punctuation(t) -> Column:
    """The last character, if a character after the first is neither a word character nor a period; else ``false``."""
    t = _c(t)
    return F.when(t.rlike(r"^.+[^.A-Za-z0-9_]"), F.substring(t, -1, 1)).otherwise("false")


def word_form(t) -> Column:
    """The abbreviated form, ``false`` for numbers."""
    a = abbrev_token(t)
    return F.when(a.rlike(r"^[0-9]+$"), "false").otherwise(a)


OPTIONAL_FEATURES = {
    "bracketed": bracketed,
    "fullbracketed": full_bracketed,
    "more.vowels": more_vowels,
    "endsinpunc": ends_in_punctuation,
    "word": word_form,
    "hyphenated": hyphenated,
    "contracted": contracted,
    "just.letters": just_letters,
    "initial": initial,
    "endswith.vowel": ends_with_vowel,
    "roman": roman,
    "abbrev": abbreviation,
    "length.code": length_code,
    "digits": digits,
    "case": casing,
    "trailing.zeros": trailing_zeros,
}
