"""Keys that tell rows with the same id apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.graph import written
from wordloom.llm.sieve import likely_in


def with_row_keys(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` (with a long column ``id``) and two more columns: ``version``, a hash of the text that tells texts
    with the same id apart (0 for most ids that one row has), and ``again``, true for all but one row of an id and text.

    Rows with a null id are never ``again``.  Only rows whose id likely
    occurs twice are written; their copies are numbered there, once.
    """
    known = F.col("id").isNotNull()
    shared = written(rows.where(known).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "shared_ids")
    alone = lambda df: df.withColumn("version", F.lit(0).cast("long")).withColumn("again", F.lit(False))
    if shared.isEmpty():
        return alone(rows)
    likely = likely_in(shared, "id")
    flagged = rows.withColumn("_shared", likely(F.col("id")) & known)
    part = written(flagged.where("_shared").drop("_shared").withColumn("version", F.xxhash64(text)).withColumn("_copy", F.monotonically_increasing_id()), "shared_rows")
    first = part.groupBy("id", "version").agg(F.min("_copy").alias("_copy")).select("_copy", F.lit(False).alias("again"))
    part = part.join(first, "_copy", "left").withColumn("again", F.coalesce("again", F.lit(True))).drop("_copy")
    return alone(flagged.where("not _shared").drop("_shared")).unionByName(part)
