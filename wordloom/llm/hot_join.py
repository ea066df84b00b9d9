"""Joins whose left side may have a key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if more than one in SHARE rows has it: at most SHARE keys are, whatever the table.
SHARE = 200
LEAST_HOT = 1000


def split_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``side`` (one row a key) on ``keys`` (inner or left).

    Rows with hot keys stay where they are and meet the at most `SHARE`
    broadcast rows of these keys; all others are shuffled.  ``rows`` is read
    three times, so it should be a written table.  ``sizes`` (keys, _n) has
    the rows a key where they are known already.
    """
    total = rows.count()
    sizes = sizes if sizes is not None else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > max(LEAST_HOT, total // SHARE)).select(*keys)
    found = [tuple(r) for r in hot.collect()]  # at most SHARE keys
    if not found:
        return rows.join(side, keys, how)
    known = rows.sparkSession.createDataFrame(found, rows.select(*keys).schema)
    stay = rows.join(F.broadcast(known), keys, "left_semi").join(F.broadcast(side.join(F.broadcast(known), keys, "left_semi")), keys, how)
    return stay.unionByName(rows.join(F.broadcast(known), keys, "left_anti").join(side, keys, how))
