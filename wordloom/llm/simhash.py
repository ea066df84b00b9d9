"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has bit i where more than half of its shingle hashes
have it.  Two fingerprints within ``radius`` bits have, in one of their two
halves, at most radius // 2 differing bits.  So every distinct fingerprint
emits, for each half, all variants of that half within half the radius; the
variants are shuffled, meet the unchanged halves of the other fingerprints,
and colliding pairs are deduplicated and verified on all 64 bits.

Groups of many distinct fingerprints that share a half (a large family of
near copies) are not paired with each other: they are hashed once more, by
balls in the other half (see `_hot_links`), which takes rows in proportion
to the group's size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import LOWER, text_slices, utf8_texts
from wordloom.llm.graph import connected_components, written

HALF = 32


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long, long columns ``keep``): the fingerprint of every whole text; 0 for a null text or one without words."""
    lower = LOWER.tobytes()

    def one(text: bytes) -> int:
        words = text.translate(lower).split()
        if not words:
            return 0
        n = max(1, len(words) - shingle + 1)
        count, step = np.zeros(64, np.int64), 1 << 16
        for at in range(0, n, step):
            m = min(n, at + step)
            grams = map(b" ".join, zip(*(words[at + j:m + j] for j in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
            h = np.fromiter(map(digest, grams), np.uint64, m - at)
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int.from_bytes(np.packbits(count * 2 > n, bitorder="little").tobytes(), "little", signed=True)

    def digest(gram: bytes) -> int:
        return xxhash.xxh64_intdigest(gram, 42)

    def run(batches):
        for b in batches:
            for first, last in text_slices(b, "text"):
                fp = [one(t) for t in utf8_texts(b.column("text").slice(first, last - first))]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, last - first), pa.array(fp, pa.int64()), *(b.column(c).slice(first, last - first) for c in keep)], ["id", "fp", *keep])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep) \
        .mapInArrow(run, "id long, fp long" + "".join(f", {c} long" for c in keep))


def _ball(bits: range, within: int) -> list[int]:
    """Masks of at most ``within`` of the given bits."""
    return [sum(1 << b for b in some) for k in range(within + 1) for some in combinations(bits, k)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(fps: DataFrame, radius: int = 3, hot: int = 64) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all pairs within ``radius``.

    ``fps`` has one long column ``fp`` of distinct values.  Pairs that meet
    in a half of at most ``hot`` members are verified one by one; larger
    groups go through `_hot_links`.
    """
    halves = [range(HALF), range(HALF, 64)]
    keyed = None
    for i, bits in enumerate(halves):
        other = _signed(sum(1 << b for b in bits))
        part = fps.select("fp", F.lit(i).alias("half"), F.col("fp").bitwiseAND(F.lit(other)).alias("key"))
        keyed = part if keyed is None else keyed.unionByName(part)
    sizes = keyed.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n"))
    exact = written(keyed.join(sizes, ["half", "key"]), "halves")

    masks = [F.array(*[F.lit(_signed(m)) for m in _ball(bits, radius // 2)]) for bits in halves]
    variants = exact.where(F.col("n") <= hot).select(
        F.col("fp").alias("a"), "half",
        F.explode(F.transform(F.when(F.col("half") == 0, masks[0]).otherwise(masks[1]), lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    small = exact.where(F.col("n") <= hot).select(F.col("fp").alias("b"), "half", "key")
    pairs = variants.join(small, ["half", "key"]).where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= radius)) \
        .select("a", "b").distinct()
    big = sizes.where(F.col("n") > hot)
    if big.isEmpty():
        return pairs
    return pairs.unionByName(_hot_links(exact, halves, radius, hot))


def _hot_links(exact: DataFrame, halves: list[range], radius: int, hot: int) -> DataFrame:
    """Edges that join members of large groups to everything within the radius, without pairing the group.

    The group's fingerprints emit the balls of radius ``near`` and ``far``
    (near + far = radius) around themselves, in full meet-in-the-middle
    fashion: whoever has a variant in the near ball is within the radius of
    all who have it in the far ball, so one star a variant (its least near
    member to all others) has the same components as all pairs.  A split of
    the differing bits over the halves fixes what is flipped where: the key
    half differs in at most radius // 2 bits, the other half in the rest.
    """
    near, far = radius // 2, radius - radius // 2
    # Fingerprints that can meet a large group: its members, and those whose half is within radius // 2 of its key.
    big = exact.where(F.col("n") > hot).select("half", "key").distinct()
    masks = [F.array(*[F.lit(_signed(m)) for m in _ball(bits, radius // 2)]) for bits in halves]
    keys = big.select("half", F.explode(F.transform(F.when(F.col("half") == 0, masks[0]).otherwise(masks[1]),
                                                    lambda m: F.col("key").bitwiseXOR(m))).alias("key")).distinct()
    members = written(exact.join(keys, ["half", "key"], "left_semi").select("fp").distinct(), "hot_members")
    inner = F.array(*[F.lit(_signed(m)) for m in _ball(range(64), near)])
    # Of `far` flips in 64 bits only those are needed that leave at most near flips to the other side;
    # among radius differing bits some half has at least far of them when radius <= 3, so far flips stay in one half.
    outer = sorted({m for bits in halves for m in _ball(bits, far)}) if radius <= 3 else _ball(range(64), far)
    outer = F.array(*[F.lit(_signed(m)) for m in outer])
    at = lambda masks: F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")
    inside = members.select("fp", at(inner))
    centre = inside.groupBy("variant").agg(F.min("fp").alias("centre"))
    return members.select("fp", at(outer)).join(centre, "variant").where("fp <> centre") \
        .select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): every document with its fingerprint and the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows share their fingerprint; an empty table gives no rows.
    Rows with a null id have no place in the result.
    """
    fp = written(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle), "fingerprints")
    first = written(fp.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    parts = connected_components(fingerprint_links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    # The component of fingerprints is named by its least document.
    named = parts.join(first, "fp")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    best = first.join(named.join(least, "component").select("fp", "least"), "fp", "left") \
        .select("fp", F.coalesce("least", "first").alias("component"))
    return fp.join(best, "fp").select("id", "fp", "component")


def near_copies(rows: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, version): of ``rows`` (id, version, text) those that are not the least of their component, by id and then version."""
    fp = written(fingerprints(rows.where(F.col("id").isNotNull()), "id", "text", shingle, ("version",)), "fingerprints")
    first = written(fp.groupBy("fp").agg(F.min(F.struct("id", "version")).alias("first")), "distinct")
    parts = connected_components(fingerprint_links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = parts.join(first, "fp")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    best = first.join(named.join(least, "component").select("fp", "least"), "fp", "left") \
        .select("fp", F.coalesce("least", "first").alias("best"))
    return fp.join(best, "fp").where("id <> best.id or version <> best.version").select("id", "version").distinct()
