"""Removal of repeated passages with suffix automata of reference shards.

A window is ``window`` consecutive words of one document; a word goes if a
window that covers it also starts anywhere else.

1. Every window has an anchor, the least hashed run of ``ANCHOR`` words in it.
   Consecutive windows with the same anchor form a segment, so each window
   lies in one segment, and equal windows have equal anchors.  Counts of
   segments by anchor and content cover the whole corpus.
2. A second pass sends on only segments whose anchor is repeated.  Segments
   with equal content are settled by their count.
3. Distinct segments that share an anchor are the reference: dealt by anchor
   into shards of bounded size, each shard gets a suffix automaton with
   occurrence counts, and the shard's segments are streamed through it.
   Anchors with very many distinct segments don't go to one shard; their
   windows are counted one by one by a grouped sum.
4. Repeated windows of a segment come back as a bit mask to all documents
   that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import SPACE, WordHasher, as_long, mix, text_slices, utf8_texts
from wordloom.llm.graph import written
from wordloom.llm.sieve import bit_table, has_bit, left_join_some
from wordloom.llm.suffix_automaton import SuffixAutomaton

ANCHOR = 8
SHARD_WORDS = 80_000
# Distinct segments of an anchor beyond which its windows are counted by a grouped sum.
ANCHOR_SEGMENTS = 4_000
TABLE_BITS = 26
_U = np.uint64
_BASE = _U(0xC2B2AE3D27D4EB4F)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the rolling hash's base and its inverse, as many as were needed so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


class _Rolling:
    """Hashes of any run of words from prefix sums."""

    def __init__(self, word: np.ndarray, powers: _Powers):
        up, self.down = powers.upto(len(word) + 1)
        self.sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """For each place the leftmost least of the next ``width`` grams, by doubling."""
    best = np.arange(len(gram))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(gram[b] < gram[a], b, a)
        span += step
    return best


def segments(word: np.ndarray, first: np.ndarray, window: int, powers: _Powers):
    """Segments of the texts of a slice: (text, first word, one past the last, anchor, content) as arrays."""
    none = np.zeros(0, np.int64)
    if len(word) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    roll = _Rolling(word, powers)
    at = np.arange(len(word) - ANCHOR + 1)
    gram = roll(at, at + ANCHOR)
    best = _anchors(gram, window - ANCHOR + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = owner[:len(best)] == owner[window - 1:window - 1 + len(best)]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    pick = best[starts]
    edge = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])]))
    begin = starts[edge]
    end = starts[np.concatenate([edge[1:], [len(starts)]]) - 1] + window
    anchor = pick[edge]
    content = mix(roll(begin, end) ^ mix((anchor - begin).astype(np.uint64)))
    return owner[begin], begin, end, gram[anchor], content


def _count_segments(docs: DataFrame, window: int) -> DataFrame:
    """(a, e, n): segments of the corpus by anchor and content; every task adds up its own first."""
    def run(batches):
        hasher, powers = WordHasher(SPACE), _Powers()
        for b in batches:
            for x, z in text_slices(b, "text"):
                _, _, _, anchor, content = segments(*hasher(utf8_texts(b.column("text").slice(x, z - x))), window, powers)
                order = np.lexsort((content, anchor))
                anchor, content = anchor[order], content[order]
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])) if len(order) else order
                yield pa.RecordBatch.from_arrays([as_long(anchor[new]), as_long(content[new]), pa.array(np.diff(np.concatenate([new, [len(order)]])))], ["a", "e", "n"])

    return docs.select("text").mapInArrow(run, "a long, e long, n long")


def _repeated_segments(docs: DataFrame, repeated, mixed, window: int) -> DataFrame:
    """(a, e, id, version, start, windows, words): segments with a likely repeated anchor; words (once a slice) where the anchor is likely mixed."""
    def run(batches):
        hasher, powers = WordHasher(SPACE), _Powers()
        for b in batches:
            for x, z in text_slices(b, "text"):
                word, first = hasher(utf8_texts(b.column("text").slice(x, z - x)))
                text, begin, end, anchor, content = segments(word, first, window, powers)
                keep = np.flatnonzero(has_bit(repeated.value, anchor))
                text, begin, end, anchor, content = text[keep], begin[keep], end[keep], anchor[keep], content[keep]
                show = np.zeros(len(keep), bool)
                show[np.unique(content, return_index=True)[1]] = True
                show &= has_bit(mixed.value, anchor)
                words = pa.array([word[i:j].tobytes() if s else None for i, j, s in zip(begin.tolist(), end.tolist(), show.tolist())], pa.binary())
                ids, versions = (b.column(c).slice(x, z - x).to_numpy(zero_copy_only=False) for c in ("id", "version"))
                yield pa.RecordBatch.from_arrays([as_long(anchor), as_long(content), pa.array(ids[text].astype(np.int64)), pa.array(versions[text].astype(np.int64)), pa.array(begin - first[text]),
                                                  pa.array((end - begin - window + 1).astype(np.int32)), words], names)

    names = ["a", "e", "id", "version", "start", "windows", "words"]
    return docs.select("id", "version", "text").mapInArrow(run, "a long, e long, id long, version long, start long, windows int, words binary")


def _shard_masks(reference: DataFrame, shards: int, window: int) -> DataFrame:
    """(a, e, mask): bit i tells that the segment's window i occurs at least twice in the corpus."""
    def run(key: Tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held = SuffixAutomaton(), []
        for b in rows:
            for a, e, n, raw in zip(*(b.column(c).to_pylist() for c in ("a", "e", "n", "words"))):
                words = np.frombuffer(raw, np.uint64).tolist()
                automaton.add(words, n)
                held.append((a, e, words))
        automaton.finish()
        masks = [sum(1 << i for i, hit in enumerate(automaton.repeated(words, window)) if hit) for _, _, words in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(masks, pa.int64())],
                                         ["a", "e", "mask"])

    return reference.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(run, "a long, e long, mask long")


def _window_masks(reference: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many segments: windows as rows, counted by their hash."""
    def run(batches):
        powers = _Powers()
        for b in batches:
            for a, e, n, raw in zip(*(b.column(c).to_pylist() for c in ("a", "e", "n", "words"))):
                word = np.frombuffer(raw, np.uint64)
                start = np.arange(len(word) - window + 1)
                h = _Rolling(word, powers)(start, start + window)
                full = np.full(len(start), 1)
                yield pa.RecordBatch.from_arrays([pa.array(full * a), pa.array(full * e), pa.array(full * n), pa.array(start.astype(np.int32)), as_long(h)],
                                                 ["a", "e", "n", "i", "h"])

    rows = written(reference.mapInArrow(run, "a long, e long, n long, i int, h long"), "hot_windows")
    often = rows.groupBy("a", "h").agg(F.sum("n").alias("total")).where("total >= 2").select("a", "h")
    return rows.join(often, ["a", "h"]).groupBy("a", "e").agg(F.expr("bit_or(shiftleft(cast(1 as bigint), i))").alias("mask"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, version, text): the row's own id, and a key of it and its text; a null id is keyed by its text alone."""
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    version = F.when(own.isNull(), F.xxhash64(text, F.lit("null id"))).otherwise(F.xxhash64(text))
    return docs.select(own.alias("doc"), F.coalesce(own, F.lit(0)).alias("id"), version.alias("version"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id, version, starts array<long>, masks array<long>): bit i of a mask tells that the window at start + i is repeated.

    Only documents with repeated windows have a row.  Null texts have no
    words.  ``version`` is a hash of the text: texts with the same id have a
    row each, windows of repeated rows (the same id and text) repeat each other.
    Rows with a null id count like any other; their ``id`` is 0 here and their ``version`` another hash of the text.
    """
    if not ANCHOR < window < ANCHOR + 63:
        raise ValueError("the window must be longer than an anchor, and a segment's windows must fit in 63 bits")
    spark = docs.sparkSession
    docs = _keyed(docs, id_col, text_col).drop("doc")
    counts = _count_segments(docs, window).groupBy("a", "e").agg(F.sum("n").alias("n"))
    kinds = written(counts, "segment_counts")
    anchors = written(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total >= 2"), "anchors")
    repeated = spark.sparkContext.broadcast(bit_table(anchors, "a", TABLE_BITS))
    mixed = spark.sparkContext.broadcast(bit_table(anchors.where("kinds >= 2"), "a", TABLE_BITS))
    seen = written(_repeated_segments(docs, repeated, mixed, window), "segments")

    known = written(kinds.join(anchors, "a"), "repeated_kinds")  # a, e, n, kinds, total
    reference = seen.where("words is not null").groupBy("a", "e").agg(F.min("words").alias("words")) \
        .join(known.where("kinds >= 2"), ["a", "e"]).select("a", "e", "n", "kinds", "words")
    reference = written(reference, "reference")
    size = reference.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-size // 8 // SHARD_WORDS))
    masks = _shard_masks(reference.where(F.col("kinds") <= ANCHOR_SEGMENTS).drop("kinds"), shards, window) \
        .unionByName(_window_masks(reference.where(F.col("kinds") > ANCHOR_SEGMENTS).drop("kinds"), window))
    # Segments of equal content are repeated throughout: all their windows count.
    whole = known.where("n >= 2").select("a", "e", F.lit(-1).cast("long").alias("mask"))
    masks = written(masks.where("mask <> 0").unionByName(whole).groupBy("a", "e").agg(F.expr("bit_or(mask)").alias("mask")), "masks")
    hits = seen.select("a", "e", "id", "version", "start", "windows").join(masks, ["a", "e"]) \
        .select("id", "version", "start", F.col("mask").bitwiseAND(F.expr("shiftleft(cast(1 as bigint), windows) - 1")).alias("mask"))
    return hits.groupBy("id", "version").agg(F.collect_set(F.struct("start", "mask")).alias("x")).select("id", "version", "x.start", "x.mask") \
        .withColumnRenamed("start", "starts").withColumnRenamed("mask", "masks")  # the segments of one text


def _removed(n: int, starts, masks, window: int) -> np.ndarray:
    """Whether each of n words is covered by a repeated window."""
    step = np.zeros(n + 1, np.int64)
    for s, m in zip(starts, masks):
        while m:
            i = (m & -m).bit_length() - 1
            run = (~(m >> i) & ((m >> i) + 1)).bit_length() - 1
            step[s + i] += 1
            step[s + i + run - 1 + window] -= 1
            m &= ~(((1 << run) - 1) << i)
    return np.cumsum(step[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) for every row: its words without the repeated passages, joined by one space.

    Null and empty texts have no words; rows with a null id lose theirs like any other.
    """
    spans = written(repeated_spans(docs, id_col, text_col, window), "spans")
    rows = _keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            for a, z in text_slices(b, "text"):
                part = b.slice(a, z - a)
                out = []
                for text, starts, masks in zip(utf8_texts(part.column("text")), part.column("starts").to_pylist(), part.column("masks").to_pylist()):
                    words = text.split()
                    n = len(words)
                    if starts:
                        gone = _removed(n, starts, masks, window).tolist()
                        words = [w for w, g in zip(words, gone) if not g]
                    out.append((n, n - len(words), b" ".join(words)))
                columns = [part.column("doc"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                           pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
                if keep_text:
                    columns.append(pa.array([x[2].decode("utf-8", "replace") for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    return left_join_some(rows, spans, "id", "version").select("doc", "text", "starts", "masks") \
        .mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
