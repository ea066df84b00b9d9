"""Joins that leave most of the wide rows where they are: a bit table of fixed size rules out rows, a join decides on the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of one of Spark's bitmaps: 32,768.
MAP_BITS = 15


def bit_table(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """Packed bits at the low ``bits`` bits of the (hashed) long column; 2**bits bits, whatever the number of keys.

    Every task sets the bits of its own keys in Spark's bitmaps, which are merged range by range.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    maps = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", MAP_BITS).alias("range")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << MAP_BITS) - 1))).alias("bits"))
    table, width = np.zeros((1 << bits) // 8, np.uint8), (1 << MAP_BITS) // 8
    for r in maps.where("range is not null").collect():  # 2**bits bits
        # Spark's bitmaps begin at a byte's least bit
        table[r["range"] * width:(r["range"] + 1) * width] = np.packbits(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
    return table


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.int64) & (len(table) * 8 - 1)
    return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def likely_in(keys: DataFrame, *columns: str, bits: int = 24):
    """A column function: whether a value (one of each column) is likely among ``keys`` (true for all that are, and for few others)."""
    shared = keys.sparkSession.sparkContext.broadcast(bit_table(keys.select(F.xxhash64(*columns).alias("h")), "h", bits))

    @F.pandas_udf("boolean")
    def likely(h):
        import pandas as pd
        return pd.Series(has_bit(shared.value, h.to_numpy()))

    return lambda *values: likely(F.xxhash64(*values))


def left_join_some(rows: DataFrame, some: DataFrame, *key: str) -> DataFrame:
    """``rows`` left-joined with ``some`` (few keys, one row each); only rows that are likely to match are shuffled."""
    likely = likely_in(some, *key)
    flagged = rows.withColumn("_likely", likely(*(rows[k] for k in key)))
    rest = flagged.where("not _likely").drop("_likely")
    for f in some.schema.fields:
        if f.name not in key:
            rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return flagged.where("_likely").drop("_likely").join(some, list(key), "left").unionByName(rest)
