"""Exact top-k search by inner product with a pivot-distance index.

Rows are keyed by their nearest pivot and their distance to it, cut into
annuli, and packed into blocks sorted by distance.  A query first searches
its own block, which gives it a k-th score to beat.  It then visits the
annuli whose bound beats that score: by the triangle inequality a row of an
annulus is at least the gap between the query's pivot distance and the
annulus away, and the inner product is at most half of
|query|^2 + |row|^2 - gap^2.  Ties of the k-th score are visited too, so the
result is exact.  Queries travel in packs; one pack meets one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.graph import written

PIVOTS = 16
ANNULI = 8
SAMPLE = 4096
BLOCK_ROWS = 4096
PACK_QUERIES = 512


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) of every vector without null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("v", bad)).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first points of the sample."""
    x = sample.astype(np.float64)
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    picks = [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(picks) < min(pivots, len(x)) and far.max() > 0:
        picks.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[picks[-1]], axis=1))
    return x[picks]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1), 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum stays below 2**53, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query, id, score) of each query's k best, its own id left out, ties to smaller ids; none below ``floor``."""
    ok = own[:, None] != ids[None, :]
    if scores.shape[1] > k + 1:
        low = np.iinfo(np.int64).min
        cut = np.partition(np.where(ok, scores, low), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        ok &= scores >= cut[:, None]
    if floor is not None:
        ok &= scores >= floor[:, None]
    q, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.concatenate([head, [len(q)]])))
    q, c = q[rank < k], c[rank < k]
    return q, ids[c], scores[q, c]


def top_k(vectors: DataFrame, queries=lambda id_: F.pmod(id_, F.lit(50)) == 0, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, pivots: int = PIVOTS, annuli: int = ANNULI) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest integer inner product of each query row, all if there are fewer.

    ``queries`` tells from an id whether its row is a query.  Vectors that
    are null or hold null or non-finite components take no part; shorter
    vectors count as filled up with zeros.  Rows that repeat an id and vector
    are one row.  A row is no candidate for a query of its own id.
    """
    spark = vectors.sparkSession
    x = written(_integers(vectors, id_col, vec_col, scale).distinct().withColumn("query", queries(F.col("id"))), "integers")
    total, width = x.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = max(1, width or 1)
    # The pivots come from a bounded sample by a hash of the id; every row is indexed.
    share = min(1.0, SAMPLE / max(1, total))
    some = x.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "x").toArrow()
    sample = _matrix(some.column("x").combine_chunks(), width)[np.argsort(some.column("id").to_numpy())] if len(some) else np.zeros((0, width), np.int64)
    centre = choose_pivots(sample, pivots)
    far = _distances(sample, centre)
    home = far.argmin(1) if len(sample) else np.zeros(0, np.int64)
    cuts = [np.quantile(far[home == p, p], np.arange(1, annuli) / annuli) if (home == p).any() else np.zeros(annuli - 1) for p in range(len(centre))]

    def index(batches):
        for b in batches:
            m = _matrix(b.column("x"), width)
            d = _distances(m, centre)
            p = d.argmin(1)
            dist = d[np.arange(len(m)), p]
            ring = np.array([int(np.searchsorted(cuts[i], t)) for i, t in zip(p.tolist(), dist.tolist())], np.int64)
            norm = (m.astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("query"), pa.array(p.astype(np.int64)), pa.array(ring), pa.array(dist), pa.array(norm),
                                              pa.array([r.tobytes() for r in m], pa.binary())], ["id", "query", "pivot", "ring", "dist", "norm", "x"])

    rows = written(x.mapInArrow(index, "id long, query boolean, pivot long, ring long, dist double, norm double, x binary"), "index")
    # One line an annulus: at most pivots * annuli, whatever the table.
    rings = rows.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist"), F.max("dist"), F.max("norm")).collect()
    if not rings:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    meta = {(r[0], r[1]): (r[2], r[3], r[4], r[5]) for r in rings}
    parts = spark.createDataFrame([(p, a, -(-v[0] // BLOCK_ROWS)) for (p, a), v in meta.items()], "pivot long, ring long, parts long")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("dist", "ascending"), ("id", "ascending")])
        ask = table.column("query").to_numpy()
        return pa.Table.from_arrays([table.column(c).slice(0, 1) for c in ("pivot", "ring")]
                                    + [pa.array([v], pa.binary()) for v in (table.column("id").to_numpy().tobytes(), table.column("dist").to_numpy().tobytes(),
                                                                            b"".join(table.column("x").to_pylist()), np.packbits(ask).tobytes())],
                                    ["pivot", "ring", "ids", "dists", "xs", "asks"])

    blocks = rows.join(F.broadcast(parts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))) \
        .groupBy("pivot", "ring", "part").applyInArrow(pack, "pivot long, ring long, ids binary, dists binary, xs binary, asks binary")
    blocks = written(blocks, "blocks")

    def ask(batches):
        """Queries with the k-th score of their own block, packed by the annuli they still have to visit."""
        keys = list(meta)
        low, high, norm = (np.array([meta[m][i] for m in keys]) for i in (1, 2, 3))
        at = np.array([m[0] for m in keys])
        for b in batches:
            for ids, xs, asks in zip(*(b.column(c).to_pylist() for c in ("ids", "xs", "asks"))):
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(xs, np.int64).reshape(-1, width)
                pick = np.flatnonzero(np.unpackbits(np.frombuffer(asks, np.uint8))[:len(ids)])
                for a in range(0, len(pick), PACK_QUERIES):
                    own = pick[a:a + PACK_QUERIES]
                    q, _, s = _best(_products(m[own], m), ids[own], ids, k)
                    kth = np.full(len(own), np.iinfo(np.int64).min)
                    full = np.bincount(q, minlength=len(own)) >= k
                    np.minimum.at(low_score := np.full(len(own), np.iinfo(np.int64).max), q, s)
                    kth[full] = low_score[full]
                    d = _distances(m[own], centre)[:, at]
                    gap = np.maximum(0, np.maximum(low - d, d - high))
                    own_norm = (m[own].astype(np.float64) ** 2).sum(1)[:, None]
                    bound = np.minimum((own_norm + norm - gap ** 2) / 2, np.sqrt(own_norm * norm))
                    go = bound * (1 + 1e-9) + 1 >= kth[:, None]
                    out = [(keys[j][0], keys[j][1], own[go[:, j]], kth[go[:, j]]) for j in range(len(keys)) if go[:, j].any()]
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                                      pa.array([ids[o[2]].tobytes() for o in out], pa.binary()), pa.array([m[o[2]].tobytes() for o in out], pa.binary()),
                                                      pa.array([o[3].tobytes() for o in out], pa.binary())], ["pivot", "ring", "q_ids", "q_xs", "kths"])

    def regroup(batches):
        """Small packs of one annulus joined to packs of about PACK_QUERIES queries."""
        held: dict = {}
        for b in batches:
            for p, a, *blobs in zip(*(b.column(c).to_pylist() for c in ("pivot", "ring", "q_ids", "q_xs", "kths"))):
                have = held.setdefault((p, a), [b"", b"", b""])
                have[:] = [h + n for h, n in zip(have, blobs)]
                if len(have[0]) >= PACK_QUERIES * 8:
                    yield _packs({(p, a): held.pop((p, a))})
        if held:
            yield _packs(held)

    def _packs(some):
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int64()), pa.array([a for _, a in some], pa.int64()),
                                           *(pa.array([v[i] for v in some.values()], pa.binary()) for i in range(3))], ["pivot", "ring", "q_ids", "q_xs", "kths"])

    kind = "pivot long, ring long, q_ids binary, q_xs binary, kths binary"
    packs = written(blocks.select("ids", "xs", "asks").mapInArrow(ask, kind).repartition("pivot", "ring").mapInArrow(regroup, kind), "packs")

    def search(batches):
        held, size = [], 0

        def reduce():
            q, i, s = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(head, np.diff(np.concatenate([head, [len(q)]])))
            return q[rank < k], i[rank < k], s[rank < k]

        for b in batches:
            for ids, dists, xs, q_ids, q_xs, kths, pivot in zip(*(b.column(c).to_pylist() for c in ("ids", "dists", "xs", "q_ids", "q_xs", "kths", "pivot"))):
                ids, dists = np.frombuffer(ids, np.int64), np.frombuffer(dists, np.float64)
                m, q_ids = np.frombuffer(xs, np.int64).reshape(-1, width), np.frombuffer(q_ids, np.int64)
                q, kths = np.frombuffer(q_xs, np.int64).reshape(-1, width), np.frombuffer(kths, np.int64)
                # Rows within reach of some query of the pack: the block is sorted by distance.
                d = _distances(q, centre[pivot:pivot + 1])[:, 0]
                top = (m.astype(np.float64) ** 2).sum(1).max()
                reach = np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1) + top - 2 * kths.astype(np.float64), 0)) * (1 + 1e-9) + 1
                first, last = np.searchsorted(dists, (d - reach).min()), np.searchsorted(dists, (d + reach).max(), side="right")
                if first < last:
                    a, i, s = _best(_products(q, m[first:last]), q_ids, ids[first:last], k, kths)
                    held.append((q_ids[a], i, s))
                    size += len(a)
                if size > 200_000:
                    held = [reduce()]
                    if len(held[0][0]) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "id", "score"])
                        held = []
                    size = sum(len(h[0]) for h in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in reduce()], ["query_id", "id", "score"])

    pairs = packs.join(blocks.select("pivot", "ring", "ids", "dists", "xs"), ["pivot", "ring"]) \
        .select("pivot", "ids", "dists", "xs", "q_ids", "q_xs", "kths")
    scored = pairs.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
