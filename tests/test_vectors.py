"""Segmentation against a brute-force greedy, outlier word, reduction, resolution, IDF."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import vectors as V
from wordloom.operators.cover import greedy_mask


def vecs(spark, table):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in table.items()], "term string, vec array<double>")


def brute_segment(text, known, max_n=4):
    words = text.lower().split()
    spans = [(n, s) for n in range(max_n, 0, -1) for s in range(0, len(words) - n + 1)]
    covered, out = set(), []
    for n, s in spans:
        g = "_".join(words[s:s + n])
        if g in known and not covered & set(range(s, s + n)):
            covered |= set(range(s, s + n))
            out.append(" ".join(words[s:s + n]))
    return out


def test_greedy_mask():
    assert greedy_mask([0, 1, 2, 3], [2, 2, 2, 2]) == [True, False, True, False]
    assert greedy_mask([], []) == []


def test_segment_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["a", "b", "c", "d", "e"]
    known = {"a": [1, 0], "b_c": [0, 1], "c_d_e": [1, 1], "e": [2, 2], "a_b_c_d": [3, 0], "d": [0, 3]}
    texts = [" ".join(rng.choice(vocab, size=rng.integers(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: list(r.grams) for r in V.segment(df, "id", "t", vecs(spark, known), drop_stopwords=False).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_segment(t, known), t
    # Q6: a single stopword ("a") is never a segment by default; longer grams containing it still are
    dropped = {r.id: list(r.grams) for r in V.segment(df, "id", "t", vecs(spark, known)).collect()}
    known_wo_a = {k: v for k, v in known.items() if k != "a"}
    for i, t in enumerate(texts):
        assert dropped[i] == brute_segment(t, known_wo_a), t


def test_segment_mean_and_unknown(spark):
    known = {"hot": [1.0, 0.0], "water": [0.0, 1.0]}
    df = spark.createDataFrame([(1, "hot water"), (2, "zzz")], "id long, t string")
    r = {x.id: x for x in V.segment(df, "id", "t", vecs(spark, known)).collect()}
    assert r[1].vec == [0.5, 0.5] and r[2].vec is None and r[2].n_grams == 0


def test_outlier_and_reduce(spark):
    known = {"red": [1.0, 0.0], "blue": [0.9, 0.1], "pipe": [0.0, 1.0]}
    df = spark.createDataFrame([(1, "red blue pipe"), (2, "foo bar"), (3, "one")], "id long, t string")
    o = {r.id: r.outlier for r in V.outlier_words(df, "id", "t", vecs(spark, known)).collect()}
    assert o == {1: "pipe", 2: None, 3: None}
    red = {r.id: r.reduced for r in V.reduce_entities(df, "id", "t", vecs(spark, known)).collect()}
    assert red == {1: "red blue", 2: "foo", 3: "one"}


def test_resolve(spark):
    known = {"smoke_alarm": [2.0, 0.0], "door": [0.0, 1.0], "a_b_c_d_e": [1.0, 1.0]}
    ents = spark.createDataFrame([(1, "object", "smoke alarm"), (2, "object", "front door"),
                                  (3, "object", "zz yy"), (4, "object", "a b c d e f")],
                                 "id long, type string, entity string")
    r = {x.id: (x.method, x.vec) for x in V.resolve_entities(ents, vecs(spark, known)).collect()}
    assert r[1] == ("direct", [2.0, 0.0])
    assert r[2] == ("segment", [0.0, 1.0])
    assert r[3] == ("none", None)
    assert r[4] == ("reduced", [1.0, 1.0])  # prefix of five words is a direct key


def test_resolve_long_unknown_text_jumps(spark):
    known = {"a_b": [1.0, 0.0], "door": [0.0, 1.0]}
    long_text = "a b " + " ".join(f"w{i}" for i in range(200))
    ents = spark.createDataFrame([(1, "object", long_text.upper())], "id long, type string, entity string")
    # upper case: no word known in its own case, lower-cased grams contain "a b" -> segment
    r = V.resolve_entities(ents, vecs(spark, known)).first()
    assert r.method == "segment"
    ents2 = spark.createDataFrame([(2, "object", "A B " + " ".join(f"W{i}" for i in range(200)))],
                                  "id long, type string, entity string")
    known2 = {"A_B": [1.0, 1.0]}
    r2 = V.resolve_entities(ents2, vecs(spark, known2)).first()
    assert r2.method == "reduced" and r2.resolved_text == "A B"


def test_idf_and_weights(spark):
    df = spark.createDataFrame([("t", "hot water"), ("t", "hot air"), ("u", "cold")], "type string, text string")
    idf = V.idf_by_type(df, "type", "text")
    got = {(r.type, r.gram): r.idf for r in idf.collect()}
    assert math.isclose(got[("t", "hot")], math.log(3 / 3) + 1)
    assert math.isclose(got[("t", "hot water")], math.log(3 / 2) + 1)
    q = spark.createDataFrame([("t", "hot"), ("t", "nope"), ("zz", "hot")], "type string, w string")
    w = {(r.type, r.w): r.weight for r in V.with_weights(q, "type", "w", idf).collect()}
    assert math.isclose(w[("t", "nope")], math.log(3 / 2) + 1) and w[("zz", "hot")] == 1.0


def test_norm_and_mean(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "g int, vec array<double>")
    n = df.select(V.l2_norm("vec").alias("n"), V.normalized("vec").alias("u")).collect()
    assert n[0].n == 5.0 and n[0].u == [0.6, 0.8] and n[2].u == [0.0, 0.0]
    m = {r.g: r.vec for r in V.mean_vectors(df, "g", "vec").collect()}
    assert m[1] == [2.0, 2.0]


def resolve_by_rounds(entity, known, stop, max_n=4):
    """(method, text) of one entity, one reduction after the other, as the original does it."""
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in known.items()}

    def hit(words):
        if "_".join(words) in known:
            return "direct"
        low = [w.lower() for w in words]
        grams = {"_".join(low[i:i + n]) for n in range(1, max_n + 1) for i in range(len(low) - n + 1)} - stop
        return "segment" if grams & known.keys() else None

    words, rounds = entity.split(), 0
    while True:
        how = hit(words)
        if how:
            return (how if not rounds else "reduced"), " ".join(words)
        if len(words) <= 1:
            return "none", " ".join(words)
        have = [w for w in words if w in known]
        if have:
            mean = sum(unit[w] for w in have) / len(have)
            _, out = min((round(float(unit[w] @ mean), 9), w) for w in set(have))
            words.remove(out)
        else:
            words.pop()
        rounds += 1


def test_resolution_is_that_of_single_rounds(spark):
    """Known words that segmentation doesn't see (stopwords, capitals) are removed first, then the last words."""
    rng = random.Random(9)
    stop = {"the", "of", "is"}
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
    known = {k: vec() for k in ["the", "of", "is", "Big", "Small", "a_b", "c_the_d", "A_B_C_D_E", "X_Y", "q_r_s_t_u_v", "The_end", "e_of", "b_c_d"]}
    alphabet = ["the", "of", "is", "Big", "Small", "A", "B", "C", "D", "E", "X", "Y", "q", "r", "s", "t", "u", "v", "The", "end", "c", "d", "b"]
    ents = ["", "the", "Big", "the of", "Big Small", "A B C D E the F", "the A of B C D E", "q r s t u v w x"]
    ents += [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["the Big " * 40 + "X Y the"]
    df = spark.createDataFrame([(i, "t", e) for i, e in enumerate(ents)], "id long, type string, entity string")
    got = {r.id: (r.method, r.resolved_text, r.vec is None) for r in V.resolve_entities(df, vecs(spark, known), stopwords=sorted(stop)).collect()}
    want = {i: resolve_by_rounds(e, known, stop) for i, e in enumerate(ents)}
    assert got == {i: (m, t, m == "none") for i, (m, t) in want.items()}
    assert {m for m, _ in want.values()} == {"direct", "segment", "reduced", "none"}


def test_weights_are_joined_without_a_table_of_all_grams(spark):
    """The n-grams' weights, which the planner takes for a small table, stay off the driver; repeated, null and unknown keys."""
    texts = spark.createDataFrame([("a", "one two three"), ("a", "two three"), ("b", "one four"), (None, "one")], "type string, t string")
    idf = V.idf_by_type(texts, "type", "t")
    idf = idf.unionByName(idf.where("type = 'b' and gram = 'four'"))
    words = spark.createDataFrame([("a", "two", 1), ("a", "two", 2), ("a", "new", 3), ("b", "four", 4), ("c", "two", 5), (None, "one", 6), ("a", None, 7)], "type string, w string, k int")
    out = V.with_weights(words, "type", "w", idf)
    got = sorted((r.k, round(r.weight, 6)) for r in out.collect())
    top = {"a": math.log(3 / 2) + 1, "b": math.log(2 / 2) + 1}
    want = [(1, 1.0), (2, 1.0), (3, top["a"]), (4, top["b"]), (4, top["b"]), (5, 1.0), (6, 1.0), (7, top["a"])]
    assert got == [(k, round(x, 6)) for k, x in want]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # the grams are counted once, before


def test_segment_by_numbers_of_vectors(spark, monkeypatch):
    """Terms that share vectors: the spans bring the vector's number along, on broadcast and on shuffled sides."""
    texts = ["a b c a b", "b c d", "", None, "x y", "a b c a b", "c d a"]
    df = spark.createDataFrame([(i if i != 5 else 0, t) for i, t in enumerate(texts)] + [(None, "a b")], "id long, t string")
    number = {"a_b": 0, "a": 1, "b": 1, "b_c_d": 2, "d_a": 0, "zz": 2}
    vec = {0: [1.0, 0.0], 1: [0.0, 2.0], 2: [3.0, 3.0]}
    keys = spark.createDataFrame(list(number.items()), "term string, vec_id long")
    table = spark.createDataFrame(list(vec.items()), "vec_id long, vec array<double>")
    whole = keys.join(table, "vec_id").select("term", "vec")

    def rows(r):
        return sorted((x.id if x.id is not None else -1, tuple(x.grams), x.n_grams, tuple(x.vec) if x.vec is not None else ()) for x in r.collect())

    want = rows(V.segment(df, "id", "t", whole, drop_stopwords=False))
    assert rows(V.segment(df, "id", "t", table, keys=keys, drop_stopwords=False)) == want
    assert (1, ("b_c_d".replace("_", " "),), 1, (3.0, 3.0)) in want
    monkeypatch.setattr(V, "checked_broadcast", lambda d, *bounds, **kw: d)
    r = V.segment(df, "id", "t", table, keys=keys, drop_stopwords=False)
    assert rows(r) == want
    assert "BroadcastHashJoin" not in r._jdf.queryExecution().sparkPlan().toString()
