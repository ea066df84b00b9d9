"""Nearest centroid for any number of centroids (CLU-4), as joins of packs of points with cells of centroids.

A share of the centroids, a bounded number, are pivots.  Every centroid
belongs to its nearest pivot's cell, a cell has the radius of its farthest
centroid.  Points travel in packs of one home cell, centroids in blocks of
one cell, so a row of the joins is a matrix.

1. A pack meets its home cell, which gives each point a distance to beat.
2. A cell whose pivot is farther from the point than that distance plus the
   cell's radius can't hold a nearer centroid (triangle inequality).  The
   points that a cell may still serve go there, and the least of all wins.

Results are exact: candidates that the fast distances can't tell apart are
compared by sums of squared differences, ties go to the smaller centroid id.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wordloom.operators.vectors import as_double
from wordloom.session import stage_path

# Centroids a cell, pivots at most (all are broadcast), rows of a pack or a block.
CELL = 256
MAX_PIVOTS = 4096
PACK = 2048
# Distances that one numpy step holds; rows with matrices that go to Python at a time.
AREA, MATRIX_ROWS = 1 << 20, 32


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * x @ c.T, 0)


def best_of(x: np.ndarray, c: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, id) of each row's nearest row of ``c``; ties to the smaller id."""
    found = np.empty(len(x)), np.empty(len(x), ids.dtype)
    step = max(1, AREA // len(c))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        d = _square(part, c)
        slack = 1e-9 * ((part ** 2).sum(1) + (c ** 2).sum(1).max()) + 1e-300
        row, col = np.nonzero(d <= (d.min(1) + slack)[:, None])
        exact = np.concatenate([((part[row[i:i + step]] - c[col[i:i + step]]) ** 2).sum(1) for i in range(0, len(row), step)])
        order = np.lexsort((ids[col], exact, row))
        first = order[np.searchsorted(row[order], np.arange(len(part)))]
        found[0][at:at + step], found[1][at:at + step] = exact[first], ids[col[first]]
    return found


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each row's nearest pivot, a step of rows at a time."""
    cell, dist = np.empty(len(x), np.int32), np.empty(len(x))
    step = max(1, AREA // len(pivots))
    for at in range(0, len(x), step):
        d = _square(x[at:at + step], pivots)
        cell[at:at + step], dist[at:at + step] = d.argmin(1), np.sqrt(d.min(1))
    return cell, dist


@contextmanager
def _few_rows(spark):
    """What is run inside sends few rows at a time to Python, as they hold matrices of about a megabyte."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(MATRIX_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _packed(rows: DataFrame) -> DataFrame:
    """(g, cell, part, ids, m): rows (g, cell, id, v) as matrices of about `PACK` rows, split by a hash of the id."""
    sizes = rows.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("parts"))  # one row a cell
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def pack(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("id").to_pylist(), _matrix(b.column("v"))) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], t) for k, t in zip(key, (g_type, pa.int32(), pa.int32()))] + [
            pa.array([[i for ids, _ in got for i in ids]], pa.list_(id_type)), pa.array([np.concatenate([m for _, m in got]).tobytes()], pa.binary())], ["g", "cell", "part", "ids", "m"])

    g_type = to_arrow_type(rows.schema["g"].dataType)
    dealt = rows.join(F.broadcast(sizes), ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return dealt.select("g", "cell", "part", "id", "v").groupBy("g", "cell", "part").applyInArrow(
        pack, f"g {rows.schema['g'].dataType.simpleString()}, cell int, part int, ids array<{rows.schema['id'].dataType.simpleString()}>, m binary")


def assign_nearest(points: DataFrame, centroids: DataFrame, group: str = "type", id_col: str = "id", vec_col: str = "vec",
                   cluster_col: str = "cluster", stats: dict | None = None) -> DataFrame:
    """(group, id, cluster, distance): each point's nearest centroid of its group by Euclidean distance.

    ``points`` has the group, an id unique in it and a vector, ``centroids``
    the group, ``cluster_col`` (long) and a vector ``vec_col``.  Groups are
    few.  Points whose vector is null, or whose group has no centroid, have
    no row.  ``stats``, when given, gets the share of (point, cell) pairs visited.
    """
    spark = points.sparkSession
    cents = _stored(centroids.where(F.col(vec_col).isNotNull()).select(F.col(group).alias("g"), F.col(cluster_col).cast("long").alias("id"), as_double(vec_col).alias("v")), "centroids")
    pts = points.where(F.col(vec_col).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), as_double(vec_col).alias("v"))
    g_kind, id_kind = (pts.schema[c].dataType.simpleString() for c in ("g", "id"))
    by_hash = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    sizes = cents.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min(by_hash).alias("least"))  # one row a group
    total = max(1, sizes.agg(F.sum("k")).first()[0] or 0)
    share = F.least(F.lit(1.0 / CELL), F.lit(MAX_PIVOTS / total)) * (1 << 31)
    chosen = cents.join(F.broadcast(sizes), "g").where((by_hash < share) | (by_hash == F.col("least"))).select("g", "v")
    pivots: dict = {}
    for r in chosen.collect():  # MAX_PIVOTS, and one a group
        pivots.setdefault(r["g"], []).append(r["v"])
    shared = spark.sparkContext.broadcast({g: np.array(sorted(v)) for g, v in pivots.items()})

    def home(batches):
        for b in batches:
            gs = np.array(b.column("g").to_pylist(), object)
            cell, dist = np.full(len(gs), -1, np.int32), np.zeros(len(gs))
            for g in {x for x in gs.tolist() if x in shared.value}:
                some = np.flatnonzero(gs == g)
                cell[some], dist[some] = nearest_pivot(_matrix(b.column("v").take(pa.array(some))), shared.value[g])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], [*b.schema.names, "cell", "dist"])

    kind = lambda i: f"g {g_kind}, id {i}, v array<double>, cell int, dist double"
    cents = _stored(cents.mapInArrow(home, kind("long")), "cells")
    radii = {(r["g"], r["cell"]): r["r"] for r in cents.groupBy("g", "cell").agg(F.max("dist").alias("r")).collect()}  # one row a pivot
    blocks = _stored(_packed(cents.drop("dist")), "blocks").select("g", "cell", F.col("ids").alias("cids"), F.col("m").alias("cm"))
    homes = _stored(pts.mapInArrow(home, kind(id_kind)).where("cell >= 0"), "homes")
    packs = _stored(_packed(homes.drop("dist")), "packs")

    g_type = to_arrow_type(pts.schema["g"].dataType)
    found_kind = f"g {g_kind}, home int, part int, at binary, d binary, c binary"

    def meet(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i] for n in b.schema.names}
                c = np.frombuffer(r["cm"].as_buffer())
                ids = r["cids"].values.to_numpy()
                c = c.reshape(len(ids), -1)
                x = np.frombuffer(r["m"].as_buffer()).reshape(-1, c.shape[1])
                d, best = best_of(x, c, ids)
                at = r["at"].as_py() if r["at"].is_valid else np.arange(len(x), dtype=np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r["g"].as_py()], g_type), pa.array([r["home"].as_py()], pa.int32()), pa.array([r["part"].as_py()], pa.int32()),
                                                  *(pa.array([y], pa.binary()) for y in (at, d.tobytes(), best.tobytes()))], ["g", "home", "part", "at", "d", "c"])

    def least(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = c = None
        for b in batches:
            for at, x, ids in zip(*(b.column(n).to_pylist() for n in ("at", "d", "c"))):
                at, x, ids = np.frombuffer(at, np.int32), np.frombuffer(x), np.frombuffer(ids, np.int64)
                if d is None or len(d) <= at.max():
                    more = int(at.max()) + 1 - (0 if d is None else len(d))
                    d = np.concatenate([np.zeros(0) if d is None else d, np.full(more, np.inf)])
                    c = np.concatenate([np.zeros(0, np.int64) if c is None else c, np.full(more, np.iinfo(np.int64).max)])
                better = (x < d[at]) | ((x == d[at]) & (ids < c[at]))
                d[at[better]], c[at[better]] = x[better], ids[better]
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], t) for k, t in zip(key, (g_type, pa.int32(), pa.int32()))] + [
            pa.array([np.arange(len(d), dtype=np.int32).tobytes()], pa.binary()), pa.array([d.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["g", "home", "part", "at", "d", "c"])

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("g", "home", "part").applyInArrow(least, found_kind)

    one = packs.select("g", "cell", F.col("cell").alias("home"), "part", "m", F.lit(None).cast("binary").alias("at"))
    with _few_rows(spark):
        first = _stored(merged(one.join(blocks, ["g", "cell"]).mapInArrow(meet, found_kind)), "first")

    def elsewhere(batches):
        """The cells that may hold a nearer centroid, each with the points that it may serve."""
        for b in batches:
            for i in range(b.num_rows):
                g, own = b.column("g")[i].as_py(), b.column("home")[i].as_py()
                p = shared.value[g]
                x = np.frombuffer(b.column("m")[i].as_buffer()).reshape(-1, p.shape[1])
                u = np.sqrt(np.frombuffer(b.column("d")[i].as_buffer()))
                step = max(1, AREA // len(x))
                for low in range(0, len(p), step):
                    far = np.sqrt(_square(x, p[low:low + step]))
                    reach = u[:, None] + np.array([radii.get((g, j), -np.inf) for j in range(low, min(low + step, len(p)))])
                    may = far <= reach * (1 + 1e-6) + 1e-9
                    if low <= own < low + step:
                        may[:, own - low] = False
                    for j in np.flatnonzero(may.any(0)).tolist():
                        at = np.flatnonzero(may[:, j]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([g], g_type), pa.array([low + j], pa.int32()), pa.array([own], pa.int32()), pa.array([b.column("part")[i].as_py()], pa.int32()),
                                                          pa.array([x[at].tobytes()], pa.binary()), pa.array([at.tobytes()], pa.binary())], ["g", "cell", "home", "part", "m", "at"])

    asked = packs.withColumnRenamed("cell", "home").join(first.select("g", "home", "part", "d"), ["g", "home", "part"]).select("g", "home", "part", "m", "d") \
        .mapInArrow(elsewhere, f"g {g_kind}, cell int, home int, part int, m binary, at binary")
    if stats is not None:
        with _few_rows(spark):
            asked = _stored(asked, "asked")
        n, cells = homes.count(), sum(len(v) for v in pivots.values())
        stats["visited"] = ((asked.agg(F.sum(F.length("at"))).first()[0] or 0) / 4 + n) / max(1, n * cells)
    second = asked.join(blocks, ["g", "cell"]).mapInArrow(meet, found_kind)
    best = merged(first.unionByName(second))

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values
                d, c = np.frombuffer(b.column("d")[i].as_buffer()), np.frombuffer(b.column("c")[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("g")[i].as_py()] * len(ids), g_type), ids, pa.array(c), pa.array(np.sqrt(d))], ["g", "id", "cluster", "distance"])

    done = packs.withColumnRenamed("cell", "home").drop("m").join(best.drop("at"), ["g", "home", "part"]).select("g", "ids", "d", "c") \
        .mapInArrow(unpack, f"g {g_kind}, id {id_kind}, cluster long, distance double")
    with _few_rows(spark):
        done = _stored(done, "nearest")
    return done.select(F.col("g").alias(group), F.col("id").alias(id_col), F.col("cluster").alias(cluster_col), "distance")
