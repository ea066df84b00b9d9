"""Dictionary lookups for arrays of words, without exploding the rows they stand in.

A dictionary of bounded size becomes part of the expression: lists of words
and values, in the order of the words' hashes, as one literal.  A lookup then
is a projection (no join, no shuffle, also on a stream).

A larger dictionary, or one that grows with the rows, is joined with the texts' distinct words: a text stands
there as a 128-bit hash, and gets back an array of small maps, picked by the
word's hash, of its own known words only.  The rows are joined with these maps by the hash.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from wordloom.functions import text as T
from wordloom.session import DEFAULT_BROADCAST_ROWS

# A dictionary up to this size travels as a literal.
LITERAL_BYTES = 16 << 20
# Maps of a text's own words, when they are joined.
TEXT_MAPS = 64


# Stands between the entries of a literal list; words that hold it are not found.
MARK = "\x01"


def _find(maps: Column, n: int, word: Column) -> Column:
    return F.try_element_at(F.get(maps, F.pmod(F.xxhash64(word), F.lit(n)).cast("int")), word)


def _literal_list(values: list, kind: T_.DataType) -> Column:
    """A list as one literal: the optimizer folds the split and the cast of a text."""
    text = MARK.join("" if v is None else ("true" if v else "false") if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v) for v in values)
    parts = F.split(F.lit(text), MARK, -1)
    return parts if isinstance(kind, T_.StringType) else parts.try_cast(f"array<{kind.simpleString()}>")


def bounded_rows(table: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = LITERAL_BYTES) -> int | None:
    """The number of rows of a table (key, value), or None beyond the bounds."""
    line = F.to_json(F.struct("key", "value"))
    n, size = table.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(line))).first()
    return None if n > max_rows or (size or 0) > max_bytes else n


def literal_dictionary(table: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = LITERAL_BYTES) -> tuple[Column, Callable[[Column, Column], Column]] | None:
    """(the dictionary as a literal, a function of it and a word that gives the word's value) of a table (key string, value), or None beyond the bounds.

    Words lie in the order of their hashes' remainders, with a list of where
    each remainder begins, so a lookup compares the few words that share one.
    Values are strings, numbers, truth values, structs of these, or arrays of
    doubles of one length; an empty string in a struct counts as null.
    """
    n = bounded_rows(table, max_rows, max_bytes)
    if n is None:
        return None
    n = max(1, n)
    rows = sorted((r[0], r[1], r[2]) for r in table.where("key is not null").select(F.pmod(F.xxhash64("key"), F.lit(n)), "key", F.to_json(F.struct("value"))).collect())  # checked above
    rows = [(b, k, json.loads(v).get("value")) for b, k, v in rows if MARK not in k and MARK.encode("unicode_escape").decode() not in v]
    starts, at = [], 0
    for bucket in range(n + 1):
        while at < len(rows) and rows[at][0] < bucket:
            at += 1
        starts.append(at)
    kind = table.schema["value"].dataType
    values = [v for _, _, v in rows]
    if isinstance(kind, T_.StructType):
        lists = [_literal_list([(v or {}).get(f.name) for v in values], f.dataType) for f in kind.fields]
    elif isinstance(kind, T_.ArrayType):
        width = len(values[0]) if values else 0
        lists = [_literal_list([float(x) for v in values for x in v], T_.DoubleType())]
    else:
        lists = [_literal_list(values, kind)]
    names = [f"v{i}" for i in range(len(lists))]
    d = F.struct(_literal_list(starts, T_.IntegerType()).alias("starts"), _literal_list([k for _, k, _ in rows], T_.StringType()).alias("keys"),
                 *[x.alias(c) for x, c in zip(lists, names)])

    def find(d: Column, word: Column) -> Column:
        bucket = F.pmod(F.xxhash64(word), F.lit(n)).cast("int")
        first, last = F.get(d["starts"], bucket), F.get(d["starts"], bucket + 1)
        place = F.array_position(F.slice(d["keys"], first + 1, last - first), word).cast("int")

        def value(at):
            if isinstance(kind, T_.StructType):
                one = F.named_struct(*[x for f, c in zip(kind.fields, names) for x in (F.lit(f.name), F.nullif(F.get(d[c], at), F.lit("")) if isinstance(f.dataType, T_.StringType) else F.get(d[c], at))])
            elif isinstance(kind, T_.ArrayType):
                one = F.slice(d["v0"], at * width + 1, F.lit(width))
            else:
                one = F.get(d["v0"], at)
            return F.when(at.isNotNull(), one)

        return F.get(F.transform(F.array(F.when(place > 0, first + place - 1)), value), 0)

    return d, find


def with_lookup(df: DataFrame, words: Column, table: DataFrame, use: Callable[[Callable[[Column], Column]], Column], out: str,
                max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = LITERAL_BYTES, text: Column | None = None) -> DataFrame:
    """``df`` with a column ``out`` = ``use(find)``, where ``find(word)`` is the word's value in ``table`` (key string unique, value) or null.

    ``words`` is the array of all words that ``use`` may ask for; ``text`` is
    a column that determines them, if that takes less to hash.  On a stream
    the dictionary must be within the bounds.  A dictionary that grows with
    the rows is better joined at every size (``max_rows`` 0): the work then
    grows with the rows, without a jump at the bounds.
    """
    found = literal_dictionary(table, max_rows, max_bytes)
    if found is not None:
        d, find = found
        return df.withColumn(out, F.get(F.transform(F.array(d), lambda x: use(lambda w: find(x, w))), 0))
    if df.isStreaming:
        raise ValueError(f"a stream's dictionary may have {max_rows} rows and {max_bytes} bytes; label larger ones batch by batch (foreachBatch)")
    j = with_entries(df, words, table, text)
    at = F.transform("_known", lambda e: F.pmod(F.xxhash64(e["key"]), F.lit(TEXT_MAPS)))
    maps = T.let(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(TEXT_MAPS - 1)), lambda b: F.map_from_entries(F.filter("_known", lambda e, i: F.get(a, i) == b))))
    j = j.withColumn("_maps", maps)
    return j.withColumn(out, F.get(F.transform(F.array("_maps"), lambda m: use(lambda w: _find(m, TEXT_MAPS, w))), 0)).drop("_known", "_maps")


def with_entries(df: DataFrame, words: Column, table: DataFrame, text: Column | None = None) -> DataFrame:
    """``df`` with a column ``_known``: the rows of ``table`` for the row's own words as array<struct<key, value>>, null for none; see `with_lookup`."""
    text = words if text is None else text
    keyed = df.withColumns({"_k1": F.xxhash64(F.lit(1), text), "_k2": F.xxhash64(F.lit(2), text)})
    # The copies of a word of equal texts meet at the word, so they are one entry before they are shuffled again.
    per = keyed.select("_k1", "_k2", F.explode_outer(F.array_distinct(words)).alias("key")).where("key is not null").join(table.hint("shuffle_hash"), "key") \
        .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("key", "value")).alias("_known"))  # the words of one text
    return keyed.join(per.hint("merge"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
