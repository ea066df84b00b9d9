"""Session helpers: building a session, the shared stage folder and checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Side tables up to this many rows are broadcast; above it the join shuffles.
DEFAULT_BROADCAST_ROWS = 200_000


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "wordloom", extra: dict | None = None) -> SparkSession:
    """A session with AQE on and the UI off.  On a cluster pass master=None."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("WORDLOOM_DRIVER_MEMORY", "16g"),
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to a shared file system.  Only when it is unset and
    the master is local (tests) a fresh local folder is created and
    registered; on a cluster a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="wordloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written stage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (no job runs); None if unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimates are advisory
        return None


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = 256 << 20) -> DataFrame:
    """Broadcast-hint ``df`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    A side whose planner estimate is far above ``max_bytes`` is returned
    unhinted at once (no job; AQE may still convert the join from real
    sizes).  Otherwise the exact check reads at most ``max_rows + 1`` rows;
    their bytes are the lengths of their JSON text, which is not below what
    a row of numbers and strings takes by more than a few times.
    """
    est = estimated_bytes(df)
    if est is not None and est > 8 * max_bytes:
        return df
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def first_rows(df: DataFrame, order_col: str, n: int, ranges: int = 1024) -> DataFrame:
    """ORD-2: the ``n`` rows with the least ``order_col`` (an integer column; null last), without sorting.

    Rows are counted by equal ranges of the values, and again within the
    range that holds the n-th row, until that range is one value.  These
    passes read only the column; the result is a filter.  Of rows that share
    the last value as many are taken as are missing.
    """
    if n <= 0:
        return df.limit(0)
    key = F.col(order_col).cast("long")
    low, high, total = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if total < n:  # all of them, then nulls
        rest = df.where(F.col(order_col).isNull()).limit(n - total)
        return df.where(F.col(order_col).isNotNull()).unionByName(rest)
    before = 0  # rows below the range [low, high]
    while low < high:
        width = -(-(high - low + 1) // ranges)
        counts = df.where(key.between(low, high)).groupBy(F.floor((key.cast("decimal(20,0)") - low) / width).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("k"))
        for r, k in sorted(map(tuple, counts.collect())):  # at most ``ranges`` rows
            if before + k >= n:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            before += k
    return df.where(key < low).unionByName(df.where(key == low).limit(n - before))
