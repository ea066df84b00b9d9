"""Removal of repeated byte strings with difference-cover suffix arrays.

A window is ``window`` consecutive bytes of one text; a byte goes if a window
that covers it also starts anywhere else.

1. Texts are packed into blocks of about `BLOCK` bytes, written once as a
   table bucketed by block, so later passes meet a block's texts without
   shuffling them.
2. Every window has an anchor, the least hashed run of `GRAM` bytes in it.
   Consecutive windows with one anchor form a segment, so equal windows lie
   in segments with equal anchors.  A block counts its segments by anchor and
   content; grouped sums tell which anchors are repeated at all and which
   have segments of more than one content ("mixed").  Where an anchor has one
   content only, its segments are repeated as a whole.
3. Of every distinct segment of a mixed anchor one copy goes to its anchor's
   shard, a text of about `SHARD` bytes.  There the windows are sorted as
   suffixes, blockwise with a difference cover (see `suffix_array`), and
   neighbours compared byte by byte.  Anchors with very many distinct segments
   don't go to one shard: their windows are counted by hash ranges.
4. Each block gets the repeated segments and window masks that it holds and
   removes the bytes they cover.

Segments are told by 128 bits of hashes, windows within shards by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import as_long, mix, utf8_texts
from wordloom.llm.graph import written
from wordloom.llm.hot_join import split_join
from wordloom.llm.suffix_array import repeated_windows
from wordloom.session import stage_path

GRAM = 24
BLOCK = 1 << 20
BLOCK_TEXTS = 4096
SHARD = 1 << 20
# Distinct segments of an anchor beyond which its windows are counted by their hashes.
ANCHOR_SEGMENTS = 2_000
# Segments of a pack and windows of a range of hashes on that way.
PACK = 256
RANGE_WINDOWS = 1 << 21
# Places that one numpy step looks at; their numbers take the low bits of the values that are compared.
STEP_BITS = 20
_U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, sizes, data), a written table bucketed by block."""
    def pack(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([part + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                                               pa.array([b"".join(texts)], pa.binary())], ["block", "ids", "sizes", "data"])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), utf8_texts(b.column("text"))):
                if ids and (size + len(t) > BLOCK or len(ids) == BLOCK_TEXTS):
                    yield full()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield full()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(pack, "block long, ids array<long>, sizes array<long>, data binary").repartition(buckets, "block").write.format("parquet") \
        .option("path", stage_path(spark, "blocks")).option("compression", "zstd").option("parquet.block.size", 16 << 20).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


@lru_cache(8)
def _power_table(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for b in (base, pow(base, -1, 1 << 64)):
        t = np.full(1 << bits, b, np.uint64)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    return tables[0], tables[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``base`` and of its inverse."""
    up, down = _power_table(base, max(10, (n - 1).bit_length()))
    return up[:n], down[:n]


def segments(data: np.ndarray, sizes: np.ndarray, window: int):
    """Segments of a block's texts, step by step: (begin, end, anchor, content) as arrays."""
    grams = window - GRAM + 1
    step = (1 << STEP_BITS) - 2 * window
    ends = np.cumsum(sizes)
    up, down = _powers(_BASE, 1 << STEP_BITS)
    for at in range(0, max(0, len(data) - window + 1), step):
        part = np.concatenate([data[at:at + step + window - 1], np.zeros(8, np.uint8)])
        n = len(part) - 8 - GRAM + 1
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        h = words[:n] * _U(0x9E3779B97F4A7C15)
        for k in range(8, GRAM, 8):
            h ^= h >> _U(32)
            h += words[k:k + n]
            h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        starts = n - grams + 1
        # the least of the next ``grams`` values, leftmost first, by running minima from both ends of stretches as long
        low = _U((1 << STEP_BITS) - 1)
        rows = -(-n // grams)
        value = np.full(rows * grams, np.iinfo(np.uint64).max, np.uint64)
        value[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        square = value.reshape(rows, grams)
        before = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        pick = (np.minimum(behind[:starts], before[grams - 1:grams - 1 + starts]) & low).astype(np.int64)
        # windows that don't cross the end of their text
        a, b = np.searchsorted(ends, [at, at + starts - 1], side="right")
        room = np.repeat(ends[a:b + 1], np.diff(np.concatenate([[at], np.minimum(ends[a:b], at + starts), [at + starts]])))
        ok = np.flatnonzero(room - np.arange(at, at + starts) >= window)
        if not len(ok):
            continue
        pick = pick[ok]
        edge = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (ok[1:] != ok[:-1] + 1)]))
        begin = ok[edge]
        end = ok[np.concatenate([edge[1:], [len(ok)]]) - 1] + window
        anchor = pick[edge]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=sums[1:])
        body = (sums[end - GRAM + 1] - sums[begin]) * down[begin]
        content = mix(body ^ mix((anchor - begin + ((end - begin) << 20)).astype(np.uint64)))
        yield begin + at, end + at, h[anchor], content


def _each_block(batches: Iterator[pa.RecordBatch], *more: str):
    """(block, ids, sizes, data, further columns' values) of every row."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            yield (row.column("block")[0].as_py(), row.column("ids")[0], np.array(row.column("sizes")[0].as_py(), np.int64),
                   np.frombuffer(row.column("data")[0].as_buffer(), np.uint8), *(row.column(c)[0] for c in more))


def _count_segments(blocks: DataFrame, window: int) -> DataFrame:
    """(a, e, block, n): the distinct segments of each block and how often they occur in it."""
    def run(batches):
        for block, _, sizes, data in _each_block(batches):
            found = list(segments(data, sizes, window))
            if not found:
                continue
            a, e = (np.concatenate([f[i] for f in found]) for i in (2, 3))
            order = np.lexsort((e, a))
            a, e = a[order], e[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (e[1:] != e[:-1])]))
            n = np.diff(np.concatenate([new, [len(a)]]))
            yield pa.RecordBatch.from_arrays([as_long(a[new]), as_long(e[new]), pa.array(np.full(len(new), block)), pa.array(n)], ["a", "e", "block", "n"])

    return blocks.mapInArrow(run, "a long, e long, block long, n long")


def _cut_out(wanted: DataFrame, window: int) -> DataFrame:
    """(a, e, n, hot, bytes): the segments that a block is asked for (``asked``: structs of e, a, n, hot)."""
    def run(batches):
        for _, _, sizes, data, asked in _each_block(batches, "asked"):
            todo = {x["e"]: x for x in asked.as_py()}
            keys = np.array(sorted(todo), np.int64)
            rows = []
            for begin, end, _, content in segments(data, sizes, window):
                content = content.view(np.int64)
                for i in np.flatnonzero(np.isin(content, keys)).tolist():
                    x = todo.pop(int(content[i]), None)
                    if x:
                        rows.append((x["a"], x["e"], x["n"], x["hot"], data[begin[i]:end[i]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names)
                    rows = []

    names = ["a", "e", "n", "hot", "bytes"]
    return wanted.mapInArrow(run, "a long, e long, n long, hot boolean, bytes binary")


def _shard_masks(reference: DataFrame, shards: int, window: int) -> DataFrame:
    """(a, e, mask): bit i tells that the segment's window i occurs at least twice."""
    def run(key: Tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in rows for x in zip(*(b.column(c).to_pylist() for c in ("a", "e", "n", "bytes")))]
        hits = repeated_windows([x[3] for x in held], [x[2] for x in held], window)
        keep = [i for i, h in enumerate(hits) if h.any()]
        yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.int64()),
                                          pa.array([np.packbits(hits[i]).tobytes() for i in keep], pa.binary())], ["a", "e", "mask"])

    return reference.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(run, "a long, e long, mask binary")


def _window_masks(reference: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many segments: windows are counted by 128-bit hashes.

    Segments travel in packs.  A pack's distinct windows go, as arrays, to
    ranges of hashes of bounded size, which send back a bit for each of them.
    """
    def pack(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                some = b.slice(at, PACK)
                raw = some.column("bytes").to_pylist()
                lists = [pa.array([some.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("a", "e", "n")]
                yield pa.RecordBatch.from_arrays([pa.array([part + n]), *lists, pa.array([[len(x) for x in raw]], pa.list_(pa.int64())), pa.array([b"".join(raw)], pa.binary()),
                                                  pa.array([sum(len(x) - window + 1 for x in raw)])], ["pack", "a", "e", "n", "sizes", "data", "windows"])
                n += 1

    packs = written(reference.mapInArrow(pack, "pack long, a array<long>, e array<long>, n array<long>, sizes array<long>, data binary, windows long"), "hot_packs")
    ranges = max(1, -(-(packs.agg(F.sum("windows")).first()[0] or 0) // RANGE_WINDOWS))

    def hashed(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys sorted by range, a key's range, each window's key, each window's segment) of a pack."""
        sizes = np.array(row["sizes"].as_py(), np.int64)
        data = np.frombuffer(row["data"].as_buffer(), np.uint8).astype(np.uint64) + _U(1)
        count = sizes - window + 1
        owner = np.repeat(np.arange(len(sizes)), count)
        start = np.arange(count.sum()) + owner * (window - 1)
        h = np.empty((len(start), 2), np.uint64)
        for k, base in enumerate((_BASE, 0xD6E8FEB86659FD93)):
            up, down = _powers(base, len(data))
            sums = np.concatenate([[_U(0)], np.cumsum(data * up)])
            h[:, k] = mix((sums[start + window] - sums[start]) * down[start])
        at = (h[:, 0] % _U(ranges)).astype(np.int64)
        order = np.lexsort((h[:, 1], h[:, 0], at))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]).any(1)])
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(new) - 1
        first = order[new]
        return h[first], at[first], key, owner

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield {c: b.column(c)[i] for c in b.schema.names}

    def send(batches):
        for row in each(batches):
            keys, at, key, owner = hashed(row)
            n = np.bincount(key, weights=np.array(row["n"].as_py(), float)[owner]).astype(np.int64)
            for r in np.unique(at).tolist():
                mine = at == r
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([row["pack"].as_py()]), pa.array([keys[mine].tobytes()], pa.binary()), pa.array([n[mine].tobytes()], pa.binary())],
                                                 ["range", "pack", "keys", "n"])

    def count(key: Tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(p, np.frombuffer(k, np.uint64).reshape(-1, 2), np.frombuffer(n, np.int64)) for b in rows for p, k, n in zip(*(b.column(c).to_pylist() for c in ("pack", "keys", "n")))]
        keys = np.concatenate([k for _, k, _ in held])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(1)])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        often = np.bincount(group, weights=np.concatenate([n for _, _, n in held])) >= 2
        edge = np.cumsum([0, *(len(k) for _, k, _ in held)])
        for (p, _, _), x, z in zip(held, edge[:-1].tolist(), edge[1:].tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(often[group[x:z]]).tobytes()], pa.binary())], ["pack", "range", "bits"])

    def masks(batches):
        for row in each(batches):
            keys, at, key, owner = hashed(row)
            often = np.zeros(len(keys), bool)
            for x in row["answers"].as_py():
                mine = np.flatnonzero(at == x["range"])
                often[mine] = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[:len(mine)]
            hit = np.split(often[key], np.flatnonzero(np.diff(owner)) + 1)
            keep = [i for i, h in enumerate(hit) if h.any()]
            yield pa.RecordBatch.from_arrays([row[c].values.take(pa.array(keep, pa.int64())) for c in ("a", "e")] + [pa.array([np.packbits(hit[i]).tobytes() for i in keep], pa.binary())], ["a", "e", "mask"])

    answers = packs.select("pack", "n", "sizes", "data").mapInArrow(send, "range long, pack long, keys binary, n binary").groupBy("range").applyInArrow(count, "pack long, range long, bits binary") \
        .groupBy("pack").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))  # a bit for each window of one pack
    return packs.select("pack", "a", "e", "sizes", "data").join(answers, "pack").mapInArrow(masks, "a long, e long, mask binary")


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, keep_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) for every row: its text's UTF-8 bytes without the repeated strings.

    ``kept`` is binary (a removed string may end within a character), ``spans``
    the removed runs as (start, end) in bytes.  Null and empty texts have no
    bytes.  Every row is a text of its own, with a null or repeated id too;
    equal rows repeat each other.  Texts may have any length that a cell may
    have.  Other columns are not looked at; an empty table gives an empty result.
    """
    if not GRAM < window < 1 << 12:
        raise ValueError(f"the window must be longer than an anchor of {GRAM} bytes and shorter than 4096")
    blocks = _blocks(docs, id_col, text_col)
    counts = written(_count_segments(blocks, window), "segment_counts")
    anchors = counts.groupBy("a").agg(F.sum("n").alias("total"), (F.min("e") != F.max("e")).alias("mixed"), F.count(F.lit(1)).alias("_n")).where("total >= 2")
    anchors = written(anchors.select("a", "mixed", "_n"), "anchors")
    seen = written(split_join(counts, anchors.select("a", "mixed"), ["a"], sizes=anchors.select("a", "_n")), "repeated_segments")
    kinds = seen.where("mixed").groupBy("a", "e").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    kinds = written(kinds, "kinds")
    many = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > ANCHOR_SEGMENTS).select("a", F.lit(True).alias("hot"))
    asked = split_join(kinds, written(many, "hot_anchors"), ["a"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))) \
        .groupBy("block").agg(F.collect_list(F.struct("e", "a", "n", "hot")).alias("asked"))  # some of the segments of one block
    reference = written(_cut_out(blocks.join(asked, "block"), window), "reference")
    size = reference.where("not hot").agg(F.sum(F.length("bytes"))).first()[0] or 0
    masks = _shard_masks(reference.where("not hot").drop("hot"), max(1, -(-size // SHARD)), window)
    if not many.isEmpty():
        masks = masks.unionByName(_window_masks(reference.where("hot").drop("hot"), window))
    masks = written(masks, "masks")
    nothing = F.lit(None).cast("binary")
    hits = seen.where("not mixed").select("block", "e", nothing.alias("mask")).unionByName(seen.where("mixed").join(masks, ["a", "e"]).select("block", "e", "mask"))
    hits = hits.groupBy("block").agg(F.collect_list(F.struct("e", "mask")).alias("hits"))  # the segments of one block

    def run(batches):
        for _, ids, sizes, data, hits in _each_block(batches, "hits"):
            gone = _covered(data, sizes, hits.as_py() or [], window)
            rows, at = [], 0
            for n in sizes.tolist():
                text, off = data[at:at + n], gone[at:at + n]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], off, [0]]).astype(np.int8)))
                kept = text[~off].tobytes()
                rows.append((n, int(off.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept, [{"start": s, "end": z} for s, z in edge.reshape(-1, 2).tolist()]))
                at += n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][:len(names) - 1]
            yield pa.RecordBatch.from_arrays([ids.values, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * keep_text
    return blocks.join(hits, "block", "left").mapInArrow(
        run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * keep_text)


def _covered(data: np.ndarray, sizes: np.ndarray, hits: list[dict], window: int) -> np.ndarray:
    """Which bytes of a block lie in a repeated window."""
    if not hits:
        return np.zeros(len(data), bool)
    masks = {x["e"]: x["mask"] for x in hits}
    keys = np.array(sorted(masks), np.int64)
    step = np.zeros(len(data) + 1, np.int32)
    for begin, end, _, content in segments(data, sizes, window):
        content = content.view(np.int64)
        for i in np.flatnonzero(np.isin(content, keys)).tolist():
            mask, b = masks[int(content[i])], int(begin[i])
            if mask is None:
                step[b] += 1
                step[end[i]] -= 1
            else:
                w = b + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))[:int(end[i]) - b - window + 1])
                step[w] += 1
                step[w + window] -= 1
    return np.cumsum(step[:-1]) > 0
