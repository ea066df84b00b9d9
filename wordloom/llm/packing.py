"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by a hash of their id into groups of bounded size; each
group is packed by itself, longest pieces first.  A piece goes to the open
bin it leaves the least room in.  If none has room, a bin opens at the
permitted length with the least cost a token, given what is still to come,
and at the end every bin shrinks to the least permitted length that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 20_000


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths, ascending, and what a sequence costs beside its length."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: int = 64

    def cost(self, length: int) -> int:
        return length + self.overhead


def pack_sizes(sizes: np.ndarray, lengths: Lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset in it, length of each bin) for pieces of 1 to the greatest permitted length."""
    order = np.argsort(-sizes, kind="stable")
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: dict[int, list[int]] = {}     # free room -> open bins
    free = 0                             # bit r is set if some open bin has room r
    used, opened = [], []
    left = int(sizes.sum())
    for i in order.tolist():
        s = int(sizes[i])
        fitting = free >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
        else:
            # Cost a token if what is left fills the bin as far as it can.
            room = min((c for c in lengths.permitted if c >= s), key=lambda c: (lengths.cost(c) / min(c, left), c))
            b = len(used)
            used.append(0)
            opened.append(room)
        place[i], offset[i] = b, used[b]
        used[b] += s
        left -= s
        if room > s:
            rooms.setdefault(room - s, []).append(b)
            free |= 1 << room - s
    permitted = np.array(lengths.permitted)
    return place, offset, permitted[np.searchsorted(permitted, used)] if used else np.zeros(0, np.int64)


SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id string, bin_length int, bin_used int, offset int"


def pack_documents(docs: DataFrame, lengths: Lengths = Lengths(), id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """A row for each piece: its document, place there, and its bin, the bin's length and tokens, and its offset in the bin.

    Tokens are words between white space, or counted by ``tokens_col``.
    Longer documents are cut at the greatest permitted length; all tokens of
    all pieces are placed.  A text without tokens (null, empty) has one row
    with no bin.  Repeated rows are packed each, null ids too.
    """
    count = F.col(tokens_col).cast("long") if tokens_col else F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(count, F.lit(0)).cast("long").alias("n"))
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    most = max(lengths.permitted)

    def run(key, table):
        group = key[0].as_py()
        ids, n = table.column("doc_id").to_pylist(), table.column("n").to_numpy()
        order = sorted(range(len(n)), key=lambda i: (-n[i], ids[i] is None, ids[i] or 0))
        n = n[order]
        pieces = np.maximum(1, -(-n // most))
        owner = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[owner] - piece * most, most)
        some = size > 0
        place, offset = np.full(len(size), -1, np.int64), np.zeros(len(size), np.int64)
        place[some], offset[some], length = pack_sizes(size[some], lengths)
        held = np.bincount(place[some], size[some], minlength=len(length)).astype(np.int64)
        column = lambda x, t: pa.array(x, t, mask=~some)
        bins = np.array([f"{group}-{b}" for b in place.tolist()], object)
        at = np.maximum(place, 0)
        if not len(length):
            length = held = np.zeros(1, np.int64)
        return pa.Table.from_arrays([pa.array([ids[order[o]] for o in owner.tolist()], pa.int64()), pa.array(piece), pa.array(piece * most), pa.array(size),
                                     column(bins, pa.string()), column(length[at].astype(np.int32), pa.int32()), column(held[at].astype(np.int32), pa.int32()),
                                     column(offset.astype(np.int32), pa.int32())],
                                    ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_used", "offset"])

    return sizes.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).groupBy("_group").applyInArrow(run, SCHEMA)
