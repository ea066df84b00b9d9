"""Conversation repair and prefix tries, against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from wordloom.llm import conversation_repair as cr
from wordloom.llm import hot_join, prefix_trie

SHAPE = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"


def all_edits(codes):
    """(cost, audit) by trying every string of edits with at most two inserts in a place."""
    best = None
    for kinds in itertools.product("KRD", repeat=len(codes)):
        if any(k != "D" and c & cr.MUST_GO for k, c in zip(kinds, codes)):
            continue
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            roles, audit, cost, free = [], "", 0, []
            for i in range(len(codes) + 1):
                audit += "I" * gaps[i]
                cost += 3 * gaps[i]
                roles += [None] * gaps[i]
                if i < len(codes):
                    audit += kinds[i]
                    if kinds[i] == "D":
                        cost += 4
                    else:
                        cost += 3 * (kinds[i] == "R") + 3 * bool(codes[i] & cr.TRUNCATED)
                        roles.append(None if kinds[i] == "R" else "sua?"[codes[i] & 3])
            if best is not None and (cost, audit) >= best:
                continue
            for fill in itertools.product("ua", repeat=roles.count(None)):
                free = iter(fill)
                if SHAPE.fullmatch("".join(next(free) if r is None else r for r in roles)):
                    best = (cost, audit)
                    break
    return best


def least_strings(codes):
    """(cost, audit) by a dynamic programme over whole strings."""
    w = [(3 * len(t), t) for t in cr.TAIL]
    add = lambda x, cost, letter: (x[0] + cost, letter + x[1])
    for c in reversed(codes):
        new = []
        for q in range(4):
            ways = [add(w[q], 4, "D")]
            if not c & cr.MUST_GO:
                extra = 3 if c & cr.TRUNCATED else 0
                ways.append(add(w[cr.NEXT[q]], 3 + extra, "R"))
                if (c & 3) in cr.KEPT[q]:
                    ways.append(add(w[cr.KEPT[q][c & 3]], extra, "K"))
            new.append(min(ways))
        for _ in range(3):
            new = [min(new[q], add(new[cr.NEXT[q]], 3, "I")) for q in range(4)]
        w = new
    return w[0] if codes else (0, "")


def test_cheapest_edits_against_all_edits():
    rng = random.Random(3)
    for n in range(4):
        for _ in range(25):
            codes = bytes(rng.randrange(4) | rng.choice([0, 0, 0, cr.MUST_GO, cr.TRUNCATED]) for _ in range(n))
            assert cr.cheapest_edits(codes) == all_edits(codes) == least_strings(codes), codes


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_give_the_same_edits(block):
    rng = random.Random(block)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3]) | rng.choice([0, 0, cr.MUST_GO, cr.TRUNCATED]) for _ in range(rng.randrange(40)))
        assert cr.cheapest_edits(codes, block) == least_strings(codes)


def repaired(rows):
    """The contract's columns of one conversation, given its damaged rows (turn, role, text) in order."""
    seen, codes, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) | (cr.MUST_GO if fault in ("blank", "duplicate") else cr.TRUNCATED if fault else 0))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = least_strings(codes)
    out, it = [], iter(rows)
    for x in audit:
        row = next(it) if x != "I" else None
        want = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if x == "I":
            out.append((want, ""))
        elif x != "D":
            out.append((row[1] if x == "K" else want, row[2]))
    assert SHAPE.fullmatch("".join(r[:1] for r, _ in out))
    body = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()), out


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        out += [(c, t, "user" if fate == 4 else r, x)] * (fate != 0) * (1 + (fate == 3))
    return out


def conversations(rng, n=60):
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                  rng.choice(["Hi.", "What?", "No end", "", " \t\n", "Same!", None, "é…", "long " * 50 + "."])) for t in rng.sample(range(-2, 30), rng.randrange(1, 9))]
    rows += [(500, None, "user", "Null turn."), (None, 1, "user", "No conversation."), (501, 7, None, None)]
    rows += [(502, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)] + [(503, 1, "user", "Twice.")] * 3
    return rows


def test_repair(spark):
    rows = conversations(random.Random(5))
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as kind", "1 as head", "'y' as key").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(cr.damaged(df), ids=df).collect()}
    kept = {}
    for c, t, r, x in sorted(damage(rows), key=lambda z: (z[1] is not None, z[1] or 0)):
        kept.setdefault(c, []).append((t, r, x))
    assert got == {c: repaired(kept.get(c, []))[0] for c in {r[0] for r in rows}}
    turns = {}
    for r in cr.repaired_turns(cr.damaged(df)).collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: [x[1:] for x in sorted(v)] for c, v in turns.items()} == {c: o for c in kept if (o := repaired(kept[c])[1])}


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert cr.repair_conversations(cr.damaged(df), ids=df).count() == 0


def trie(rows):
    """The contract's rows from whole prefixes."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda z: (z[1] is not None, z[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    own_saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in nodes.items()}
    kids, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own_saved[p]
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p, m)) for p, m in nodes.items())


def test_prefix_trie(spark):
    rng = random.Random(11)
    rows = conversations(rng, 70)
    # many that share turns, long ones that part late, turnless ones
    rows += [(c, t, "user", f"common {t}") for c in range(1000, 1060) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", f"common {t if t < 60 else c}") for c in (2000, 2003, 2020) for t in range(90 + c % 7)]
    rows += [(c, 0, None, "x y  z") for c in (-45, -5, 3001, 3002, 3003)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as k1", "1 as node", "'y' as part").repartition(5)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_keys(df))).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == trie(rows)
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_keys(empty))).count() == 0


def test_subtree_sums(spark):
    rng = random.Random(4)
    parent = {0: None, **{i: i - 1 for i in range(1, 40)}, **{i: rng.randrange(i) for i in range(40, 150)}, **{i: rng.randrange(20) for i in range(150, 200)}, 200: None}
    depth = {}
    for i in parent:
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    sums = {i: i for i in parent}
    for i in sorted(parent, key=lambda i: -depth[i]):
        if parent[i] is not None:
            sums[parent[i]] += sums[i]
    df = spark.createDataFrame([(i, p, depth[i], i) for i, p in parent.items()], "node long, parent long, depth long, v long")
    assert {r.node: r.v for r in prefix_trie.subtree_sums(df, ["v"]).collect()} == sums


def test_pieces_and_hot_keys(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i) for i in range(-30_000, 30_000)] + [(7, 1)], "k long, v long")
    want = {k: hashlib.sha256(",".join(str(i) for i in range(-30_000, 30_000) if i % 3 == k).encode()).hexdigest() for k in range(3)}
    assert {r.k: r.sha256 for r in prefix_trie.sorted_digests(df, ["k"], "v").collect()} == want | {7: hashlib.sha256(b"1").hexdigest()}
    side = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (9, "d")], "k long, w string")
    got = {(r.k, r.w): r.n for r in hot_join.split_join(df, side, ["k"], "left").groupBy("k", "w").agg(F.count("v").alias("n")).collect()}
    assert got == {(0, "a"): 20_000, (1, "b"): 20_000, (2, None): 20_000, (7, "c"): 1}
