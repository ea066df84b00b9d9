"""Embedding near-duplicates by cross-polytope hashing.

Vectors are rotated by fast Hadamard transforms with random signs; a hash
names the coordinate axis (with its sign) nearest to the rotated vector.  A
table's bucket joins two such hashes; every vector lies in its own bucket and
probes the next likely ones.  Candidates of a bucket are verified by their
cosines in blocks of bounded size, no pair leaves its block: a pair is
counted in the first bucket it meets in, and what a block returns are counts
and one link to the least member of each local group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.graph import connected_components, written

TABLES = 5
PROBES = 2
# Vectors of a bucket that one block holds; larger buckets become pairs of blocks.
BLOCK = 768


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def bucket_codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: the own bucket, then those to probe."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = unit
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, other, loss = [], [], []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / width ** 0.5
            size = np.abs(y)
            two = np.argpartition(-size, 1, axis=1)[:, :2]
            a, b = two[:, 0], two[:, 1]
            swap = (size[rows, b] > size[rows, a]) | ((size[rows, b] == size[rows, a]) & (b < a))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            axis = lambda i: 2 * i + (y[rows, i] < 0)  # noqa: E731, B023
            best.append(axis(a))
            other.append(axis(b))
            loss.append(size[rows, a] - size[rows, b])
        wide = 2 * width
        out[:, t, 0] = best[0] * wide + best[1]
        first = loss[0] <= loss[1]
        turns = [np.where(first, other[0] * wide + best[1], best[0] * wide + other[1]),
                 np.where(first, best[0] * wide + other[1], other[0] * wide + best[1]), other[0] * wide + other[1]]
        for p in range(probes):
            out[:, t, 1 + p] = turns[p]
    return out


def _valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def _hashed(reps: DataFrame, tables: int, probes: int) -> DataFrame:
    def run(batches):
        for b in batches:
            flat = b.column("vec")
            width = np.diff(flat.offsets.to_numpy())
            values = flat.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(width)])
            codes = [None] * len(width)
            for d in np.unique(width):
                pick = np.flatnonzero(width == d)
                x = np.stack([values[first[i]:first[i + 1]] for i in pick])
                x = x / np.abs(x).max(1, keepdims=True)
                for i, c in zip(pick, bucket_codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes)):
                    codes[i] = c.reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), b.column("copies"), flat, pa.array(codes, pa.list_(pa.int64()))], names)

    names = ["rep", "label", "copies", "vec", "codes"]
    kind = reps.schema["label"].dataType.simpleString()
    return reps.select("rep", "label", "copies", "vec").mapInArrow(run, f"rep long, label {kind}, copies long, vec array<double>, codes array<long>")


def _block_links(rows: DataFrame, tables: int, probes: int, threshold: float) -> DataFrame:
    """(rep, links, root): what each block adds to a vector's number of links, and its least local relative."""
    per = 1 + probes

    def block(ids, copies, vec, codes, part, two):
        unit = vec / np.abs(vec).max(1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        close = unit @ unit.T >= threshold
        u, v = np.nonzero(np.triu(close, 1))
        if two:
            across = part[u] != part[v]
            u, v = u[across], v[across]
        if not len(u):
            return None
        table, bucket = codes["table"], codes["bucket"]
        own, all_ = codes["codes"].reshape(len(ids), tables, per)[:, :, 0], codes["codes"].reshape(len(ids), tables, per)
        # Buckets in which the pair meets: u's own if v lies there or probes it, and the other way round.
        at_u = (all_[v] == own[u][:, :, None]).any(2)
        at_v = (all_[u] == own[v][:, :, None]).any(2)
        here = (at_u[:, table] & (own[u, table] == bucket)) | (at_v[:, table] & (own[v, table] == bucket))
        u, v, at_u, at_v = u[here], v[here], at_u[here], at_v[here]
        if not len(u):
            return None
        least_first = ids[u] < ids[v]
        first = (at_u | at_v).argmax(1) == table
        lead_meets = np.where(least_first, at_u[:, table], at_v[:, table])
        lead_own, other_own = np.where(least_first, own[u, table], own[v, table]), np.where(least_first, own[v, table], own[u, table])
        counted = first & (np.where(lead_meets, lead_own, other_own) == bucket)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, u[counted], copies[v[counted]])
        np.add.at(links, v[counted], copies[u[counted]])
        root = ids.copy()
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            if (before == root).all():
                break
        touched = np.unique(np.concatenate([u, v]))
        return ids[touched], links[touched], root[touched]

    def run(batches):
        held = []

        def groups(table, last):
            key = np.column_stack([table.column(c).to_numpy() for c in ("key", "table", "bucket", "i", "j")])
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
            return edge if last else edge[:-1], key

        def process(table, edge, key):
            out = []
            ids, copies, part = (table.column(c).to_numpy() for c in ("rep", "copies", "part"))
            vec, codes = table.column("vec").combine_chunks(), table.column("codes").combine_chunks()
            for a, z in zip(edge[:-1], edge[1:]):
                if z - a < 2:
                    continue
                order = np.unique(ids[a:z], return_index=True)[1] + a
                got = block(ids[order], copies[order], np.array(vec.slice(a, z - a).to_pylist())[order - a],
                            {"table": key[a, 1], "bucket": key[a, 2], "codes": np.array(codes.slice(a, z - a).to_pylist())[order - a]},
                            part[order], key[a, 3] != key[a, 4])
                if got is not None:
                    out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["rep", "links", "root"])

        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            edge, key = groups(table, False)
            if len(edge) > 1:
                yield from process(table, edge, key)
                held = table.slice(int(edge[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                edge, key = groups(table, True)
                yield from process(table, edge, key)

    return rows.mapInArrow(run, "rep long, links long, root long")


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
                 tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(id, n_links, component) for every row: vectors linked directly, and the smallest id reachable.

    Vectors that are null, zero, hold null or non-finite components, or have
    no label link with nothing; so do vectors of different lengths.  Rows
    that repeat an id are one vector and give one row; null ids give none.
    """
    good = written(_valid(vectors, id_col, vec_col, label_col).distinct(), "vectors")
    reps = written(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct_vectors")
    hashed = _hashed(reps, tables, probes)
    spread = hashed.select("rep", "label", "copies", "vec", "codes", F.posexplode("codes").alias("slot", "bucket")) \
        .withColumn("table", F.floor(F.col("slot") / (1 + probes)).cast("long")) \
        .withColumn("key", F.xxhash64("label", F.size("vec"))).drop("slot", "label").dropDuplicates(["rep", "table", "bucket"])
    spread = written(spread, "bucket_rows")
    place = ["key", "table", "bucket"]
    sizes = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
    rows = spread.join(sizes, place).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    rows = rows.select("rep", "copies", "vec", "codes", *place, "part", "i", "j")
    keys = [*place, "i", "j"]
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = written(_block_links(rows.repartition(n, *keys).sortWithinPartitions(*keys), tables, probes, threshold), "block_links")
    count = local.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(local.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    state = reps.select("rep", "label", "vec", "copies").join(count, "rep", "left").join(parts, "rep", "left")
    found = good.join(state, ["label", "vec"]).select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                                      F.coalesce("component", "rep").alias("component"))
    every = vectors.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return every.join(found.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component")), "id", "left") \
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
