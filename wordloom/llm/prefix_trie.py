"""The prefix trie of a table of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns.  Its key is the exclusive or of
hashes of (place, role, text) over these turns, twice 64 bits, so a running
window gives the keys of all prefixes and no text is shuffled.

Totals come from contraction: every round *rakes* the leaves (a leaf's total
is final and goes to its parent) and *compresses* unary chains (every other
node of a chain is spliced out, its child hangs on its parent with the
spliced node's sum as an offset on the edge).  Which nodes of a chain go is
decided by one bit of the depth a round, so that a chain of length d is gone
after log2(d) rounds, and by hashes once the bits are used up.  Then the
rounds are walked back and every spliced node gets its total from its child's.
A round is three joins on unique keys; each round is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.graph import written
from wordloom.llm.hot_join import split_join

WORD = r"[^\x20\x09-\x0D]+"
# Bytes of joined ids that travel as one row to the task that digests them.
PIECE = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_keys(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv_id, pos, t1, t2, words): a conversation's turns numbered from 0, two hashes for role and text, the text's words.

    Turns go by number, null first, those with the same number by role and
    then by a hash.  Null roles and texts are empty.  Rows without a
    conversation are left out.
    """
    conv, turn, role, text = columns
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.xxhash64(F.lit(1), F.length("role"), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "text", "role").alias("t2"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "t1")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "t1", "t2", "words")


def rebuilt(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c with the first h turns of conversation c - c % 20 in the place of its own first h turns,
    h = crc32(c) % 4.  The remainder has the sign of c."""
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    ids = keys.select("conv_id").distinct()
    heads = keys.where((F.col("conv_id") % 20 == 0) & (F.col("pos") < 3)).withColumnRenamed("conv_id", "base")
    lent = ids.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": h("conv_id")}).join(heads, "base").where("pos < h")  # up to 39 x 3 rows a base
    both = lent.select("conv_id", F.lit(0).alias("part"), "pos", "t1", "t2", "words").unionByName(
        keys.where(F.col("pos") >= h("conv_id")).select("conv_id", F.lit(1).alias("part"), "pos", "t1", "t2", "words"))
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    return both.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "t1", "t2", "words"), ids


def _coin(node: str, depth: str, turn: int, bits: int) -> Column:
    return (F.shiftright(depth, turn) if turn < bits else F.xxhash64(F.lit(turn), F.col(node))).bitwiseAND(F.lit(1)) == 1


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): every node's sum of the long columns ``values`` over its subtree, itself included.

    ``tree`` has node, parent (null at a root; longs) and depth, smaller at a
    parent.  Any number of roots will do; an empty table gives an empty one.
    """
    off = [f"off_{v}" for v in values]
    active = written(tree.select("node", "parent", "depth", *values, *[F.lit(0).cast("long").alias(o) for o in off])
                     .join(tree.select(F.col("node").alias("parent"), F.col("depth").alias("pdepth")), "parent", "left"), "tree")
    bits = int(active.agg(F.max("depth")).first()[0] or 0).bit_length()
    leaves, spliced = [], []
    while True:
        turn = len(leaves)
        parents = active.where("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
        marked = written(active.join(parents, "node", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "marked")
        # Rake: a leaf's sum is final.
        leaves.append(marked.where("not inner").select("node", *values))
        inner = marked.where("inner")
        if inner.isEmpty():
            break
        gifts = marked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(~F.col("inner"), F.col(v) + F.col(o)).otherwise(0)).alias(f"got_{v}") for v, o in zip(values, off)],
            F.count(F.when(F.col("inner"), 1)).alias("kids"), F.max(F.when(F.col("inner"), F.col("node"))).alias("only"))
        goes = (F.col("kids") == 1) & F.col("parent").isNotNull() & _coin("node", "depth", turn, bits) & ~_coin("parent", "pdepth", turn, bits)
        rest = written(inner.join(gifts, "node").select("node", "parent", "depth", "pdepth", "only", F.coalesce(goes, F.lit(False)).alias("goes"),
                                                        *[(F.col(v) + F.col(f"got_{v}")).alias(v) for v in values], *off), "inner")
        # Compress: a node that goes gives its parent and its sum to its only child.
        gone = rest.where("goes").select(F.col("only").alias("node"), F.col("node").alias("up"), F.col("parent").alias("up_parent"), F.col("pdepth").alias("up_depth"),
                                         *[F.col(v).alias(f"up_{v}") for v in values], *[F.col(o).alias(f"up_{o}") for o in off])
        met = written(rest.where("not goes").join(gone, "node", "left"), "spliced")
        hung = F.col("up").isNotNull()
        spliced.append(met.where(hung).select(F.col("up").alias("node"), F.col("node").alias("child"), *[(F.col(f"up_{v}") + F.col(o)).alias(v) for v, o in zip(values, off)]))
        active = met.select("node", F.when(hung, F.col("up_parent")).otherwise(F.col("parent")).alias("parent"), "depth",
                            F.when(hung, F.col("up_depth")).otherwise(F.col("pdepth")).alias("pdepth"), *values,
                            *[(F.col(o) + F.when(hung, F.col(f"up_{v}") + F.col(f"up_{o}")).otherwise(0)).alias(o) for v, o in zip(values, off)])
    # Back through the rounds: a spliced node's child was settled later than it went.
    later = leaves.pop()
    sums = later
    for raked, part in zip(reversed(leaves), reversed(spliced)):
        if not part.isEmpty():
            back = written(part.join(later.select(F.col("node").alias("child"), *[F.col(v).alias(f"child_{v}") for v in values]), "child")
                           .select("node", *[(F.col(v) + F.col(f"child_{v}")).alias(v) for v in values]), "expanded")
            later, sums = later.unionByName(back), sums.unionByName(back)
        later, sums = later.unionByName(raked), sums.unionByName(raked)
    return sums


def sorted_digests(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, sha256): the SHA-256 of each key's long values, ascending, in decimal, joined by commas.

    Values are joined to pieces where a range of (key, value) lies, so the
    task that digests a hot key reads pieces instead of rows.
    """
    names = [*keys, "first", "piece"]

    def join(batches):
        key, first, parts, size = None, None, [], 0
        out = []
        for b in batches:
            for *k, v in zip(*(b.column(c).to_pylist() for c in (*keys, value))):
                if k != key or size > PIECE:
                    if parts:
                        out.append((*key, first, ",".join(parts)))
                    key, first, parts, size = k, v, [], 0
                parts.append(str(v))
                size += len(parts[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*out))[:-1]] + [pa.array([x[-1] for x in out], pa.string())], names)
                out = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, first)] + [pa.array([",".join(parts)], pa.string())], names)

    def digest(batches):
        key, sha, out = None, None, []
        for b in batches:
            for *k, piece in zip(*(b.column(c).to_pylist() for c in (*keys, "piece"))):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(piece.encode())
            if len(out) > 1000:
                yield batch(out)
                out = []
        if sha:
            out.append((*key, sha.hexdigest()))
        yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(len(keys))] + [pa.array([x[-1] for x in out], pa.string())], [*keys, "sha256"])

    kind = ", ".join(f"{k} long" for k in keys)
    pieces = rows.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).mapInArrow(join, f"{kind}, first long, piece string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "piece").mapInArrow(digest, f"{kind}, sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is (conv_id, pos from 0, t1, t2, words) as `turn_keys` gives it,
    ``conversations`` has every conv_id once, those without turns too.  Equal
    prefixes are told by 128 bits of hashes.  Without conversations there are
    no nodes, not even the root.
    """
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("conv_id").orderBy("pos")
    steps = turns.select("conv_id", "pos", "words", *[F.bit_xor(F.xxhash64(F.lit(i), F.col("pos"), F.col(f"t{i}"))).over(so_far).alias(f"k{i}") for i in (1, 2)])
    zero = F.lit(0).cast("long")
    steps = written(steps.select("conv_id", (F.col("pos") + 1).alias("depth"), "words", "k1", "k2", *[F.lag(f"k{i}", 1, 0).over(order).alias(f"p{i}") for i in (1, 2)],
                                 F.lead("pos").over(order).isNull().alias("last")), "prefixes")
    members = written(conversations.select("conv_id"), "members")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("depth"), zero.alias("words"), "conv_id", "n_convs")
    nodes = steps.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.first("words").alias("words"),
                                          F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).unionByName(root)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    below = nodes.where("p1 is not null")
    kids = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.join(kids, ["k1", "k2"]).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = written(parents, "parents")
    hung = split_join(below.select("node", "p1", "p2"), parents.drop("n_children"), ["p1", "p2"]).select("node", "parent", "parent_conv_id")
    tree = nodes.join(hung, "node", "left").join(parents.select(F.col("parent").alias("node"), "n_children"), "node", "left").select(
        "node", "parent", "parent_conv_id", "depth", "k1", "k2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    tree = written(tree, "trie")
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    ends = members.join(steps.where("last").select("conv_id", "k1", "k2"), "conv_id", "left").select("conv_id", F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"))
    digests = sorted_digests(written(ends, "ends"), ["k1", "k2"], "conv_id")
    return tree.drop("n_leaves", "saved_tokens").join(sums, "node").join(digests, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
