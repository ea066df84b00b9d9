"""Line deduplication as an exact set-similarity join.

A line is the set of its words (ASCII letters in lower case).  A line goes
if an earlier line (by document id, then position) has the same set or one
with a Jaccard similarity of at least the threshold, whether or not that
earlier line stays.

1. Word counts over all documents: every task counts its words in a table of
   hashed slots, the tables are summed slot range by slot range.  The sum has
   a fixed size and goes to every task; it orders words by rarity (equal
   counts by the word's hash), one order for the whole corpus.
2. Equal sets are merged to their first line before anything is paired.
3. Prefix filter: of sets ordered by rarity, two similar ones share a word
   among their first few.  These prefix words are shuffled as packed rows;
   a word that very many sets have there gives way to its pairs with the
   words behind it.  Sets that meet pass the length filter, the positional
   filter and a parity signature (differing bits never exceed the words in
   which two sets differ) or go.
4. A set needs only one earlier match, so it first offers its few best
   candidates; sets that these don't settle offer all of theirs.  A
   group of thousands of similar lines so costs rows in proportion to its size.
5. Offered pairs are verified on the whole sets, read from the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import SPACE, WordHasher, as_long, from_planes, merged, mix, planes, small_batches, text_slices, utf8_texts
from wordloom.llm.graph import written
from wordloom.llm.row_keys import with_row_keys
from wordloom.llm.sieve import bit_table, has_bit, left_join_some, likely_in

SLOT_BITS = 22
SLOT_RANGES = 64
# Candidates a set offers before it is known whether one of them matches.
OFFERS = 2
# Bits of the table of words (with the binary magnitude of the set's size) that unsettled sets have in their prefixes.
WORD_BITS = 26
# A word that more sets have in their prefixes is hot.  Postings of a unit beyond this number are split into parts, pairs of parts are groups of their own.
WORD_ROWS = 20_000
# Sets of more words meet on hot words, not on pairs with them.
LONG_SET = 64
STEP_ROWS = 100_000
SET_ROWS = 10_000
BUCKET_ROWS = 150_000
SPREAD = 0x9E3779B1
_U = np.uint64
POSTING = np.dtype([("word", "<u4"), ("doc", "<i8"), ("version", "<i8"), ("line", "<i4"), ("size", "<i4"), ("place", "<i4"), ("sig", "<u8", 2), ("side", "u1")])


def _split_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All lines, the text each belongs to, and its number there."""
    per_doc = [t.split(b"\n") for t in texts]
    count = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
    total = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(texts)), count)
    return [x for lines in per_doc for x in lines], owner, np.arange(total[-1]) - total[owner]


def _ordered_sets(word: np.ndarray, first: np.ndarray, rare: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line by rarity and then hash; returns (words, first word of each line)."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    grade = np.zeros(len(word), np.uint64) if rare is None else rare[_slots(word)].astype(np.uint64)
    if len(first) < 1 << 22:
        key = owner << _U(42) | grade << _U(34) | word >> _U(30)
        order = np.argsort(key)
        same = np.flatnonzero((key[order][1:] == key[order][:-1]) & (word[order][1:] != word[order][:-1]))
        if len(same):  # two words that the packed key can't tell apart
            order = np.lexsort((word, key))
    else:
        order = np.lexsort((word, grade, owner))
    word, owner = word[order], owner[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    size = np.bincount(owner[new].astype(np.int64), minlength=len(first) - 1)
    return word[new], np.concatenate([[0], np.cumsum(size)])


def _per_line(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    """Reduce the values of each line's words; 0 for lines without words."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros(len(first) - 1, values.dtype)
    if len(some):
        out[some] = how.reduceat(values, first[some])
    return out


def _slots(word: np.ndarray) -> np.ndarray:
    return (word >> _U(64 - SLOT_BITS)).astype(np.int64)


def _slot_table(rows: DataFrame, slots) -> tuple[np.ndarray, int]:
    """Grades (0 to 255, eight to a doubling of the count) of all slots, and the sum of the counts; ``slots`` turns a task's batches into arrays of slots.

    A task sends the slots it has seen with their counts, which are added up slot range by slot range.
    """
    width = (1 << SLOT_BITS) // SLOT_RANGES

    def count(batches):
        table = np.zeros(1 << SLOT_BITS, np.uint32)
        for slot in slots(batches):
            slot, n = np.unique(slot, return_counts=True)
            table[slot] += n.astype(np.uint32)
        seen = np.flatnonzero(table)
        edge = np.searchsorted(seen, np.arange(SLOT_RANGES + 1) * width)
        for r in np.flatnonzero(np.diff(edge)):
            part = seen[edge[r]:edge[r + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([(part % width).astype("<u2").tobytes()], pa.binary()), pa.array([planes(table[part])], pa.binary())],
                                             ["range", "slots", "counts"])

    def add(key: Tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint64)
        for t in tables:
            for slot, n in zip(t.column("slots"), t.column("counts")):
                total[np.frombuffer(slot.as_py(), "<u2")] += from_planes(n.as_py(), np.dtype("<u4"))
        grade = np.minimum(255, np.log2(total + 1.0) * 8).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([grade.tobytes()], pa.binary()), pa.array([int(total.sum())])], ["range", "grades", "total"])

    parts = rows.mapInArrow(count, "range long, slots binary, counts binary").groupBy("range").applyInArrow(add, "range long, grades binary, total long")
    table, total = np.zeros(1 << SLOT_BITS, np.uint8), 0
    for r in parts.collect():  # a table of fixed size, 4 MB; one job, not one a partition
        table[r["range"] * width:(r["range"] + 1) * width] = np.frombuffer(r["grades"], np.uint8)
        total += r["total"]
    return table, total


def _at_most(grade: np.ndarray) -> np.ndarray:
    """The greatest count that has the grade; it is within a tenth of the least."""
    return np.exp2((grade.astype(float) + 1) / 8)


def word_table(docs: DataFrame) -> np.ndarray:
    """Grade of rarity (by the logarithm of the count) of every hashed word slot, over all documents."""
    def slots(batches):
        hasher = WordHasher(SPACE, lower=True)
        for b in batches:
            for first, last in text_slices(b, "text"):
                yield _slots(hasher(utf8_texts(b.column("text").slice(first, last - first)))[0])

    return _slot_table(docs.select("text"), slots)[0]


def _line_rows(docs: DataFrame, table, num: int, den: int) -> DataFrame:
    """A row for each line that has words: its place, its set's key, size and signature, and the words of its prefix and one more."""
    def run(batches):
        hasher, rare = WordHasher(SPACE, lower=True), table.value
        for b in batches:
            for a, z in text_slices(b, "text"):
                lines, owner, number = _split_lines(utf8_texts(b.column("text").slice(a, z - a)))
                word, first = _ordered_sets(*hasher(lines), rare)
                size = np.diff(first)
                place = np.arange(len(word)) - np.repeat(first[:-1], size)
                send = place <= np.repeat(size - -(-num * size // den) + 1, size)
                at = np.concatenate([[0], np.cumsum(send)])[first].astype(np.int32)
                pre = pa.ListArray.from_arrays(pa.array(at), pa.array((word[send] >> _U(32)).astype(np.uint32).view(np.int32)))
                scrambled = (word ^ _U(0xD6E8FEB86659FD93)) * _U(0xA0761D6478BD642F)
                k1 = _per_line(word, first, np.add)
                k2 = _per_line(scrambled ^ (scrambled >> _U(29)), first, np.add)
                # 128 parity bits: a word flips one of them
                bit, high = _U(1) << (scrambled >> _U(58)), (scrambled >> _U(57) & _U(1)).astype(bool)
                sig = [_per_line(np.where(high == side, bit, _U(0)), first, np.bitwise_xor) for side in (False, True)]
                ids, versions = (b.column(c).slice(a, z - a).to_numpy(zero_copy_only=False) for c in ("id", "version"))
                out = pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(versions[owner]), pa.array(number.astype(np.int32)), as_long(k1), as_long(k2),
                                                  pa.array(size.astype(np.int32)), as_long(sig[0]), as_long(sig[1]), pre], names)
                yield out.filter(pa.array(size > 0))

    names = ["doc", "version", "line", "k1", "k2", "size", "sig0", "sig1", "pre"]
    return docs.select("id", "version", "text").mapInArrow(run, "doc long, version long, line int, k1 long, k2 long, size int, sig0 long, sig1 long, pre array<int>")


def _units(b: pa.RecordBatch, num: int, den: int, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, unit, place) of what the sets of a batch meet others on: words of the prefix, and pairs of words instead of hot ones.

    Two similar sets that differ share two words or more when the threshold is
    above one half, and their first two shared words lie among the prefix and
    one more word.  So a hot word of the prefix may be replaced by its pairs
    with the words behind it.  Sets longer than LONG_SET keep the hot word,
    and those that may be similar to shorter ones send both.  ``hot`` flags
    the slots of hot words.
    """
    pre, size = b.column("pre"), b.column("size").to_numpy().astype(np.int64)
    first = pre.offsets.to_numpy().astype(np.int64)
    n = np.diff(first)
    word = pre.values.to_numpy().view(np.uint32)[first[0]:first[-1]]
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - np.repeat(first[:-1] - first[0], n)
    # A set that is too short to be similar to any other than itself meets none.
    last = np.where(size * den >= num * (size + 1), size - -(-num * size // den), -1)
    inside = place <= last[owner]
    if hot is None:
        return owner[inside], word[inside], place[inside]
    warm = inside & hot[word >> np.uint32(32 - SLOT_BITS)]
    single = np.flatnonzero(inside & (~warm | (size[owner] > LONG_SET)))
    lead = np.flatnonzero(warm & (size[owner] <= LONG_SET * den // num))
    behind = n[owner[lead]] - 1 - place[lead]
    one = np.repeat(lead, behind)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(behind) - behind, behind)
    pair = (mix(word[one].astype(np.uint64) << _U(32) | word[two].astype(np.uint64)) >> _U(32)).astype(np.uint32)
    # Of the shared words one lies before the second word, so the place of the word before it bounds what is shared.
    return np.concatenate([owner[single], owner[one]]), np.concatenate([word[single], pair]), np.concatenate([place[single], place[two] - 1])


def _unit_table(sets: DataFrame, num: int, den: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(grades of the units' slots by the sets that have them, slots of hot words or None, number of all units)."""
    def counted(hot):
        def slots(batches):
            for b in batches:
                yield (_units(b, num, den, None if hot is None else hot.value)[1] >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
        return _slot_table(sets.select("size", "pre"), slots)

    grades, total = counted(None)
    hot = _at_most(grades) > WORD_ROWS
    if 2 * num == den or not hot.any():
        return grades, None, total
    grades, total = counted(sets.sparkSession.sparkContext.broadcast(hot))
    return grades, hot, total


def _postings(sets: DataFrame, units, num: int, den: int, buckets: int, only=None) -> DataFrame:
    """(bucket, rows): packed postings of all sets (with ``only``, a bit table, of likely those units).  Units beyond WORD_ROWS sets are split into parts: each
    posting has one part and goes to the groups of all pairs of parts with it, so a group has at most about 2 * WORD_ROWS rows of the unit."""
    def run(batches):
        grades, hot = units.value
        for b in merged(batches, SET_ROWS):
            owner, unit, place = _units(b, num, den, hot)
            if only is not None:
                magnitude = np.frexp(b.column("size").to_numpy().astype(np.float64))[1].astype(np.int64)
                keep = has_bit(only.value, unit.astype(np.int64) + magnitude[owner] * SPREAD)
                owner, unit, place = owner[keep], unit[keep], place[keep]
            parts = np.ceil(_at_most(grades[unit >> np.uint32(32 - SLOT_BITS)]) / WORD_ROWS).astype(np.int64)
            # A step makes about STEP_ROWS rows, copies for the parts counted.
            rows_out = np.cumsum(parts)
            at = 0
            while at < len(owner):
                end = max(at + 1, int(np.searchsorted(rows_out, (rows_out[at - 1] if at else 0) + STEP_ROWS, side="right")))
                yield packed(b, owner[at:end], unit[at:end], place[at:end], parts[at:end])
                at = end

    def packed(b, owner, unit, place, parts):
        row = np.zeros(len(unit), POSTING)
        row["word"], row["place"] = unit, place
        for f in ("doc", "version", "line", "size"):
            row[f] = b.column(f).to_numpy()[owner]
        for i in (0, 1):
            row["sig"][:, i] = b.column(f"sig{i}").to_numpy().view(np.uint64)[owner]
        # 2: meets all rows of its unit in the group, 0 and 1: the rows of the other part; 4 more for a set that is still open
        row["side"] = 2
        if only is not None:
            row["side"] += b.column("open").to_numpy(zero_copy_only=False).astype(np.uint8)[owner] * 4
        home = ((unit.astype(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(20)) % _U(buckets)).astype(np.int64)
        many = np.flatnonzero(parts > 1)
        if len(many):
            spread = np.repeat(many, parts[many])
            step = np.arange(len(spread)) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
            own = (row["doc"][spread].astype(np.uint64) * _U(0xD6E8FEB86659FD93) + row["version"][spread].astype(np.uint64) + row["line"][spread].astype(np.uint64) * _U(0xA0761D6478BD642F) >> _U(33)) % parts[spread].astype(np.uint64)
            own, more = own.astype(np.int64), row[spread]
            low, high = np.minimum(own, step), np.maximum(own, step)
            more["side"] = (more["side"] & 4) + np.where(low == high, 2, own == high).astype(np.uint8)
            # A pair of parts has a number of its own below 0.
            pair = mix(mix(more["word"].astype(np.uint64) << _U(32) | low.astype(np.uint64)) ^ high.astype(np.uint64))
            pair = -1 - (pair >> _U(2)).astype(np.int64)
            few = np.flatnonzero(parts == 1)
            row = np.concatenate([row[few], more])
            home = np.concatenate([home[few], pair])
        order = np.argsort(home, kind="stable")
        row, home = row[order], home[order]
        edge = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
        return pa.RecordBatch.from_arrays([pa.array(home[edge[:-1]]), pa.array([planes(row[i:j]) for i, j in zip(edge[:-1], edge[1:])], pa.binary())], ["bucket", "rows"])

    return sets.select("doc", "version", "line", "size", "sig0", "sig1", "pre", *(["open"] if only is not None else [])).mapInArrow(run, "bucket long, rows binary")


def _open_units(sets: DataFrame, units, num: int, den: int) -> DataFrame:
    """(w): keys of the units of ``sets`` with each magnitude of size that a similar set may have."""
    def run(batches):
        for b in batches:
            owner, unit, _ = _units(b, num, den, units.value[1])
            # Similar sets differ by less than a factor of two in size: magnitudes next to each other.
            magnitude = np.frexp(b.column("size").to_numpy().astype(np.float64))[1].astype(np.int64)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([unit.astype(np.int64) + (magnitude + d) * SPREAD for d in (-1, 0, 1)])))], ["w"])

    return sets.select("size", "pre").mapInArrow(run, "w long")


PLACE = ["doc", "version", "line"]
PAIR = "u_doc long, u_version long, u_line int, v_doc long, v_version long, v_line int, far int, more boolean"
# Pairs that one numpy step looks at.
AREA = 200_000


def _meet(postings: DataFrame, num: int, den: int, offers: int) -> DataFrame:
    """Pairs (u, v earlier than u) that pass all filters; with ``offers``, so many of each u and step, nearest signatures first.

    ``far`` is the signatures' distance; ``more`` tells that u had others.  Without ``offers`` only open sets are a u.
    """
    def block(rows, size, sig, among, i, start, above):
        """Pairs of the rows i and the ``above`` rows from each one's ``start`` in ``among``."""
        x = np.repeat(i, above)
        y = among[np.arange(len(x)) - np.repeat(np.cumsum(above) - above - start, above)]
        far = np.bitwise_count(sig[0][x] ^ sig[0][y]).astype(np.int32) + np.bitwise_count(sig[1][x] ^ sig[1][y])
        both = size[x] + size[y]
        need = -(-num * both // (num + den))
        near = np.flatnonzero(far <= both - 2 * need)
        x, y, far, need = x[near], y[near], far[near], need[near]
        a, b = rows[x], rows[y]
        ok = np.minimum(a["size"] - a["place"], b["size"] - b["place"]) >= need
        ok &= (a["doc"] != b["doc"]) | (a["version"] != b["version"]) | (a["line"] != b["line"])
        a, b, x, y, far = a[ok], b[ok], x[ok], y[ok], far[ok]
        later = (a["version"] > b["version"]) | ((a["version"] == b["version"]) & (a["line"] > b["line"]))
        later = (a["doc"] > b["doc"]) | ((a["doc"] == b["doc"]) & later)
        u, v = np.where(later, x, y), np.where(later, y, x)
        if not offers:  # only sets that are still open ask
            still = rows["side"][u] >= 4
            u, v, far = u[still], v[still], far[still]
        more = np.zeros(len(u), bool)
        if offers and len(u):
            order = np.lexsort((v, far, u))
            u, v, far = u[order], v[order], far[order]
            head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            n = np.diff(np.concatenate([head, [len(u)]]))
            keep = np.arange(len(u)) - np.repeat(head, n) < offers
            u, v, far, more = u[keep], v[keep], far[keep], np.repeat(n > offers, n)[keep]
        a, b = rows[u], rows[v]
        return pa.RecordBatch.from_arrays([*(pa.array(x[f]) for x in (a, b) for f in ("doc", "version", "line")), pa.array(far), pa.array(more)],
                                          ["u_doc", "u_version", "u_line", "v_doc", "v_version", "v_line", "far", "more"])

    def run(key: Tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([from_planes(x.as_py(), POSTING) for t in tables for x in t.column("rows")])
        rows = rows[np.lexsort((rows["line"], rows["version"], rows["doc"], rows["size"], rows["side"] & 3, rows["word"]))]
        size, sig, side = rows["size"].astype(np.int64), rows["sig"].T.copy(), (rows["side"] & 3).astype(np.int64)
        # By word, side and size: the partners of a row are the rows from its size to the greatest that fits, behind it or on the other side
        # (on side 0 those of equal size are the partners, not on side 1).
        word = np.cumsum(np.concatenate([[True], rows["word"][1:] != rows["word"][:-1]])).astype(np.int64) << 34 if len(rows) else size
        key, other = word | side << 32 | size, word | np.array([1, 0, 2])[side] << 32
        start = np.where(side == 2, np.arange(len(rows)) + 1, np.searchsorted(key, (other | size) + (side == 1), side="left"))
        above = np.searchsorted(key, other | np.minimum(size * den // num, 0x7FFFFFFF), side="right") - start
        every = np.arange(len(rows))
        if offers:
            asks = [(every, every, start, above)]
        else:  # pairs with an open set: an open row meets all its partners, any other row its open partners
            still = rows["side"] >= 4
            askers, others, place = np.flatnonzero(still), np.flatnonzero(~still), np.concatenate([[0], np.cumsum(still)])
            asks = [(every, askers, start[askers], above[askers]),
                    (askers, others, place[start[others]], place[start[others] + np.maximum(above[others], 0)] - place[start[others]])]
        for among, i, start, above in asks:
            some = np.flatnonzero(above > 0)
            i, start, above = i[some], start[some], above[some]
            total = np.cumsum(above)
            at = 0
            while at < len(i):
                done = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, done + AREA, side="right")))
                yield block(rows, size, sig, among, i[at:end], start[at:end], above[at:end])
                at = end

    return postings.groupBy("bucket").applyInArrow(run, PAIR)


def _offered(pairs: DataFrame, offers: int) -> DataFrame:
    """Of each u's pairs the ``offers`` nearest; ``more`` tells that u has others.

    A u has at most a few pairs from each of its prefix words.
    """
    near = F.slice(F.array_sort(F.collect_set(F.struct("far", "v_doc", "v_version", "v_line"))), 1, offers)
    per = pairs.groupBy("u_doc", "u_version", "u_line").agg(
        near.alias("near"), F.max("more").alias("more"), F.size(F.collect_set(F.struct("v_doc", "v_version", "v_line"))).alias("n"))
    return per.select("u_doc", "u_version", "u_line", F.explode("near").alias("x"), (F.col("more") | (F.col("n") > offers)).alias("more")) \
        .select("u_doc", "u_version", "u_line", "x.v_doc", "x.v_version", "x.v_line", "more")


def _line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, version, line, words) of the wanted lines (which may repeat), from their documents; a document's lines come together."""
    def run(batches):
        hasher = WordHasher(SPACE, lower=True)
        for b in batches:
            for a, z in text_slices(b, "text"):
                lines, texts = b.column("lines").slice(a, z - a).to_pylist(), utf8_texts(b.column("text").slice(a, z - a))
                ids = zip(*(b.column(c).slice(a, z - a).to_pylist() for c in ("doc", "version")))
                picked = [(d, i, every[i]) for d, picks, every in zip(ids, lines, (t.split(b"\n") for t in texts)) for i in picks]
                word, first = _ordered_sets(*hasher([x[2] for x in picked]), None)
                yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in picked], pa.int64()), pa.array([x[0][1] for x in picked], pa.int64()), pa.array([x[1] for x in picked], pa.int32()),
                                                  pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), as_long(word))], ["doc", "version", "line", "words"])

    picks = wanted.groupBy("doc", "version").agg(F.collect_set("line").alias("lines"))  # the lines of one text
    picks = written(picks, "picked_lines")
    likely = docs.withColumnRenamed("id", "doc").where(likely_in(picks, "doc", "version")(F.col("doc"), F.col("version")))
    return likely.join(picks.hint("shuffle_hash"), ["doc", "version"]).select("doc", "version", "text", "lines").mapInArrow(run, "doc long, version long, line int, words array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, version, line) of each u that has a similar enough v among the pairs, by their whole sets."""
    u, v = (F.struct(*(F.col(f"{s}_{c}").alias(c) for c in PLACE)) for s in "uv")
    words = written(_line_sets(docs, pairs.select(F.explode(F.array(u, v)).alias("x")).select("x.*")), "line_sets")
    side = lambda s: words.select(*(F.col(c).alias(f"{s}_{c}") for c in PLACE), F.col("words").alias(f"{s}_words"))
    both = pairs.join(side("u"), [f"u_{c}" for c in PLACE]).join(side("v"), [f"v_{c}" for c in PLACE])
    common = F.size(F.array_intersect("u_words", "v_words"))
    return both.where(common * den >= (F.size("u_words") + F.size("v_words") - common) * num) \
        .select(*(F.col(f"u_{c}").alias(c) for c in PLACE)).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc, version, line): the lines that an earlier line repeats; lines count from 0.

    ``threshold`` is a fraction (numerator, denominator).  Lines without
    words, null and empty texts repeat nothing and are never repeated.  Texts
    that share an id come in the order of their hashes (``version``, see `with_row_keys`);
    of rows that share both the result names the lines of the first, all lines
    of the others are repeated.
    """
    docs = with_row_keys(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), F.col("text"))
    return _repeated(docs, threshold).distinct()


def _repeated(docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The same of rows (id, version, again, text); a line may come twice."""
    if 2 * threshold[0] < threshold[1]:
        raise ValueError("the threshold must be at least one half")
    spark, (num, den) = docs.sparkSession, threshold
    small_batches(spark)
    docs = docs.where("id is not null and not again").select("id", "version", "text")
    table = spark.sparkContext.broadcast(word_table(docs))
    lines = written(_line_rows(docs, table, num, den), "lines")

    # One row a set: its first line.
    sets = written(lines.groupBy("k1", "k2").agg(F.min(F.struct(*PLACE, "size", "sig0", "sig1", "pre")).alias("x"), F.count(F.lit(1)).alias("n")).select("k1", "k2", "n", "x.*"), "line_set_table")
    grades, hot, total = _unit_table(sets, num, den)
    units = spark.sparkContext.broadcast((grades, hot))
    buckets = max(8, total // BUCKET_ROWS)
    postings = _postings(sets, units, num, den, buckets)
    offered = written(_offered(_meet(postings, num, den, OFFERS), OFFERS), "line_pairs")
    found = written(_verified(offered, docs, num, den), "found_lines")

    # Sets with more candidates than they offered, none of which matched: now all of their pairs.
    open_ = written(offered.where("more").select(*(F.col(f"u_{c}").alias(c) for c in PLACE)).distinct().join(found, PLACE, "left_anti"), "open_lines")
    if not open_.isEmpty():
        # A set that the bit table wrongly takes for open meets pairs that it needn't; all pairs are verified.
        flagged = sets.withColumn("open", likely_in(open_, *PLACE, bits=WORD_BITS)(*(F.col(c) for c in PLACE)))
        only = spark.sparkContext.broadcast(bit_table(_open_units(flagged.where("open"), units, num, den), "w", WORD_BITS))
        pair = [f"{s}_{c}" for s in "uv" for c in PLACE]
        rest = _meet(_postings(flagged, units, num, den, buckets, only), num, den, 0).select(*pair).distinct().join(offered, pair, "left_anti")
        found = found.unionByName(_verified(written(rest, "line_pairs"), docs, num, den))

    # A set's later lines go, and its first line too if it was found.  Only lines of sets that likely have several are shuffled.
    state = written(sets.where("n > 1").select("k1", "k2", F.struct(*PLACE).alias("first")), "repeated_sets")
    several = likely_in(state, "k1", "k2", bits=WORD_BITS)
    gone = lines.select("k1", "k2", *PLACE).where(several(F.col("k1"), F.col("k2"))).join(state.hint("shuffle_hash"), ["k1", "k2"]) \
        .where("doc <> first.doc or version <> first.version or line <> first.line").select(*PLACE)
    return gone.unionByName(found)


def _gone(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(id, version, gone): numbers of the repeated lines of a text."""
    gone = _repeated(rows, threshold).groupBy(F.col("doc").alias("id"), "version").agg(F.collect_set("line").alias("gone"))
    return written(gone, "gone_lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """All rows and columns of ``docs``, the text without its repeated lines.

    Null texts stay null; a text all of whose lines go becomes empty.  Rows
    with a null id keep their text.
    """
    packed = with_row_keys(docs.select(F.col(id_col).cast("long").alias("id"), F.struct("*").alias("row")), F.col("row")[text_col])
    gone = _gone(packed.select("id", "version", "again", F.col("row")[text_col].cast("string").alias("text")), threshold)

    names, place = docs.columns, docs.columns.index(text_col)

    def cut(batches):
        for b in batches:
            row = b.column("row").flatten()
            whole = pa.RecordBatch.from_arrays([*row, b.column("gone"), b.column("again")], [str(i) for i in range(len(names) + 2)])
            texts = pa.RecordBatch.from_arrays([row[place]], ["text"])
            for first, last in text_slices(texts, "text"):
                part = whole.slice(first, last - first)
                out = []
                for text, drop, again in zip(*(part.column(i).to_pylist() for i in (place, len(names), len(names) + 1))):
                    drop = set(drop or ()) if not again else {i for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\v\f\r")}
                    out.append(text if text is None or not drop else "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop]))
                columns = [part.column(i) for i in range(len(names))]
                columns[place] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    # Only documents that a bit table of the changed ones lets through are shuffled and rewritten.
    likely = likely_in(gone, "id", "version")
    packed = packed.withColumn("likely", likely(F.col("id"), F.col("version")))
    changed = packed.where("likely and not again").join(gone.hint("shuffle_hash"), ["id", "version"], "left") \
        .unionByName(packed.where("again").withColumn("gone", F.lit(None).cast("array<int>"))).select("row", "gone", "again").mapInArrow(cut, docs.schema)
    return packed.where("not likely and not again").select("row.*").unionByName(changed)


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by newlines) for every row; null texts count as empty."""
    rows = with_row_keys(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), F.col("text"))
    gone = _gone(rows, threshold).hint("shuffle_hash")  # the same plan at every size

    def run(batches):
        for b in batches:
            ids, drops, again = (b.column(c).to_pylist() for c in ("id", "gone", "again"))
            for a, z in text_slices(b, "text"):
                out = []
                for i, text in enumerate(utf8_texts(b.column("text").slice(a, z - a)), a):
                    lines = text.split(b"\n")
                    drop = {k for k, x in enumerate(lines) if x.split()} if again[i] else set(drops[i] or ())
                    kept = b"\n".join([x for k, x in enumerate(lines) if k not in drop])
                    out.append((ids[i], len(lines), len(drop), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)

    names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string"
    copies = rows.where("again").withColumn("gone", F.lit(None).cast("array<int>"))
    return left_join_some(rows.where("not again"), gone, "id", "version").unionByName(copies).select("id", "text", "gone", "again").mapInArrow(run, schema)
