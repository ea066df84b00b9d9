"""Sequence model: Viterbi vs brute force, gradient check, fitting lowers the loss, decoding."""

import itertools

import numpy as np
from wordloom.operators import features as FE
from wordloom.operators import lookup
from wordloom.operators import sequence as SQ


def test_viterbi_brute_force():
    rng = np.random.default_rng(3)
    for n in range(1, 5):
        E = rng.normal(size=(n, 3))
        A = rng.normal(size=(3, 3))
        best = max(itertools.product(range(3), repeat=n),
                   key=lambda p: sum(E[t, p[t]] for t in range(n)) + sum(A[p[t - 1], p[t]] for t in range(1, n)))
        assert list(SQ.viterbi(E, A)) == list(best)


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    D, L = 40, 3
    W = rng.normal(size=(D, L)) * 0.3
    A = rng.normal(size=(L, L)) * 0.3
    seqs = []
    for n in [1, 2, 4, 4]:
        seqs.append((n, np.repeat(np.arange(n), 2), rng.integers(0, D, size=2 * n), rng.random(2 * n),
                     rng.integers(0, L, size=n)))

    def total(W, A):
        return sum(SQ.sequence_nll(SQ.emissions(W, n, a, b, c), A, y) for n, a, b, c, y in seqs)

    loss, G, GA = SQ.batch_gradient(W, A, *zip(*seqs))
    assert abs(loss - total(W, A)) < 1e-9
    eps = 1e-6
    i, j = int(seqs[2][2][0]), 1
    W2 = W.copy()
    W2[i, j] += eps
    assert abs(G[i, j] - (total(W2, A) - total(W, A)) / eps) < 1e-4
    A2 = A.copy()
    A2[0, 2] += eps
    assert abs(GA[0, 2] - (total(W, A2) - total(W, A)) / eps) < 1e-4


def test_fit_and_decode(spark):
    rows = []
    for i in range(40):
        rows.append((i, ["fix", "the", "sink"] if i % 2 else ["replace", "kitchen", "door"],
                     [4, 0, 2] if i % 2 else [4, 1, 2]))
    train = spark.createDataFrame(rows, "id long, tokens array<string>, y array<int>")
    hist = []
    model = SQ.fit(train, history=hist)
    assert hist[-1] < hist[0] * 0.5
    out = SQ.decode(train, model).select("tokens", "labels").collect()
    labels = model.labels
    for r, row in zip(out, rows):
        assert r.labels == [labels[k] for k in row[2]]
    empty = spark.createDataFrame([(1, [])], "id long, tokens array<string>")
    assert SQ.decode(empty, model).first()["labels"] == []


def test_decode_in_the_plan_is_the_numpy_path(spark):
    rng = np.random.default_rng(5)
    words = ["sink", "door", "a", "the", "of", "lobby", "x1", "it's"]
    rows = [(i, [str(w) for w in rng.choice(words, n)]) for i, n in enumerate([0, 1, 2, 3, 127, 128, 129, 300, 5, 7, 9])]
    df = spark.createDataFrame([*rows, (99, None)], "id long, tokens array<string>")
    lexicon = spark.createDataFrame([("sink", "NN"), ("a", "DT"), ("of", "IN")], "word string, tag string")
    enc = {r.id: r for r in SQ.with_features(df.where("tokens is not null"), "tokens", lexicon).collect()}
    model = SQ.SequenceModel(features=sorted({k for r in enc.values() for k in r.fkey})[:-3])
    # whole numbers: sums are exact, and ties are frequent
    model.W, model.A = rng.integers(-2, 3, model.W.shape).astype(float), rng.integers(-1, 2, model.A.shape).astype(float)
    number = {k: i for i, k in enumerate(model.features)}
    decoded = SQ.decode(df, model, "tokens", lexicon)
    assert "split(" not in decoded._jdf.queryExecution().optimizedPlan().toString()  # dictionaries are literals, not built for every row
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan
    for r in decoded.collect():
        if r.tokens is None:
            assert r.labels == []
            continue
        e = enc[r.id]
        some = [(t, number[k], v) for t, k, v in zip(e.ftok, e.fkey, e.fval) if k in number]
        E = SQ.emissions(model.W, e.ntok, *(list(x) for x in zip(*some))) if some else np.zeros((e.ntok, 8))
        assert r.labels == [model.labels[i] for i in SQ.viterbi(E, model.A)]


def test_large_dictionaries_are_joined(spark, monkeypatch):
    """Beyond the bound: the same features, labels and fit, no literal, and no text beside exploded words."""
    rows = [(i, ["fix", "the", f"sink{i % 7}"] if i % 2 else ["replace", "kitchen", "door"], [4, 0, 2] if i % 2 else [4, 1, 2]) for i in range(40)]
    df = spark.createDataFrame([*rows, (50, [], [])], "id long, tokens array<string>, y array<int>")
    lexicon = spark.createDataFrame([("sink1", "NN"), ("fix", "VB"), ("door", "NN"), ("the", "DT")], "word string, tag string")
    gazetteer = spark.createDataFrame([("object", "door"), ("location", "kitchen")], "kind string, term string")
    optional = ("word", "hyphenated")

    def all_of():
        """Features, loss and gradient at one point, labels under these weights, looked-up fields."""
        objective = SQ.Objective(df.where("size(tokens) > 0"), lexicon=lexicon, gazetteer=gazetteer, optional=optional)
        x = np.random.default_rng(1).integers(-3, 4, objective.size) / 4
        W, A = objective.split(x)
        model = SQ.SequenceModel(features=objective.features, optional=optional, W=W, A=A)
        labels = {r.id: r.labels for r in SQ.decode(df, model, "tokens", lexicon, gazetteer).collect()}
        pos = {r.id: r.pos for r in FE.with_pos_array(df, "tokens", lexicon, gazetteer).collect()}
        return objective.features, objective(x), labels, pos

    small = all_of()
    bounded = lookup.literal_dictionary
    monkeypatch.setattr(lookup, "literal_dictionary", lambda table, *_: bounded(table, max_rows=2))
    large = all_of()
    assert small[0] == large[0] and small[2:] == large[2:]
    assert np.isclose(small[1][0], large[1][0]) and np.allclose(small[1][1], large[1][1])
    plan = FE.with_pos_array(df, "tokens", lexicon)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate [_k1" in line]
    assert aggregates and not any("tokens#" in line or "y#" in line.replace("key#", "") for line in aggregates) and "from_json" not in plan


def test_objective_is_the_gradient_of_the_features(spark):
    """Records of neighbours give the same features, loss and gradient as features written out one by one."""
    rng = np.random.default_rng(2)
    words = ["sink", "door", "a", "the", "of", "lobby", "x1.", "it's", "b,"]
    rows = [(i, [str(w) for w in rng.choice(words, n)], [int(v) for v in rng.integers(0, 8, n)]) for i, n in enumerate([1, 1, 2, 3, 3, 7, 40, 0, 3])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, y array<int>")
    lexicon = spark.createDataFrame([("sink", "NN"), ("a", "DT"), ("of", "IN")], "word string, tag string")
    for optional in ((), ("word", "case")):
        enc = SQ.with_features(df, "tokens", lexicon, optional).collect()
        objective = SQ.Objective(df, lexicon=lexicon, optional=optional)
        assert objective.features == sorted({k for r in enc for k in r.fkey})
        number = {k: i for i, k in enumerate(objective.features)}
        x = rng.normal(size=objective.size)
        W, A = objective.split(x)
        loss, G, GA = SQ.batch_gradient(W, A, [r.ntok for r in enc], [r.ftok for r in enc], [[number[k] for k in r.fkey] for r in enc],
                                        [r.fval for r in enc], [r.y for r in enc])
        got, grad = objective(x)
        assert np.isclose(got, loss + 0.005 * x @ x) and np.allclose(grad, np.concatenate([G.ravel(), GA.ravel()]) + 0.01 * x)


def test_products_are_the_sums_of_logarithms():
    rng = np.random.default_rng(4)
    for spread in (1, 50, 5000):  # the last one is beyond what products hold
        E, A = rng.normal(size=(5, 9, 4)) * spread, rng.normal(size=(4, 4)) * spread
        for a, b in zip(SQ.forward_backward_batch(E, A), SQ._forward_backward_logs(E, A)):
            assert np.allclose(a, b)


def test_decoding_grows_with_the_text(spark):
    """A state that grows with the text is copied at every step: 16 times the tokens of a text took far more than the same tokens in 16 texts."""
    import time

    from pyspark.sql import functions as F
    A = np.random.default_rng(1).normal(size=(8, 8))

    def seconds(texts, tokens):
        e = spark.range(texts).repartition(1).select(F.transform(F.sequence(F.lit(1), F.lit(tokens)), lambda i: F.array(*[F.hash("id", i, F.lit(j)) / 1e9 for j in range(8)])).alias("e")).localCheckpoint()
        took = []
        for _ in range(2):
            at = time.time()
            assert e.agg(F.sum(F.size(SQ.viterbi_column(F.col("e"), A)))).first()[0] == texts * tokens
            took.append(time.time() - at)
        return min(took)

    assert seconds(1, 16000) < 4 * seconds(16, 1000) + 2


ODD_TOKENS = ["", "&", "...", "-.", "a..", "\"it's\"", "A.B.", "x1.", "b,", "é.", "aé", "İstanbul", "K9", "Under,", "(sink)", "sink", "kitchen", "the", "''", "o's", "ß", "_x_", "by", "&,", "door's.", "a\u0085", "to"]


def test_batches_have_the_projection_s_records_and_labels(spark):
    """Batched decoding, also of pieces and groups of texts: the same records, the same sums, the same ties."""
    import pyarrow as pa
    from wordloom.operators import batches
    lexicon = spark.createDataFrame([("sink", "NN"), ("a", "DT"), ("the", "NNS"), ("the", "VB")], "word string, tag string")
    gazetteer = spark.createDataFrame([("object", "door's."), ("location", "the"), ("object", "to")], "kind string, term string")
    single = spark.createDataFrame([(i, [t]) for i, t in enumerate(ODD_TOKENS)], "id int, tokens array<string>")
    rng = np.random.default_rng(6)
    rows = [(i, [str(w) for w in rng.choice(ODD_TOKENS, n)]) for i, n in enumerate([0, 1, 2, 3, 50, 129, 5, 1, 7])]
    df = spark.createDataFrame([*rows, (99, None)], "id long, tokens array<string>")
    for lex, gaz in ((None, None), (lexicon, None), (lexicon, gazetteer)):
        expected = {r.id: r for r in SQ.with_record_arrays(single, "tokens", lex, (), gaz).collect()}
        x, tags = batches.token_numbers(pa.array(ODD_TOKENS), *SQ.known_words(lex, gaz))
        assert x.tolist() == [expected[i].x[:10] for i in range(len(ODD_TOKENS))]
        assert [f"nltk_tag:{t}" for t in tags.to_pylist()] == [expected[i].names[0] for i in range(len(ODD_TOKENS))]
        names = {r.k for r in SQ.with_features(df.where("tokens is not null"), "tokens", lex, (), gaz).selectExpr("explode(fkey) as k").collect()}
        model = SQ.SequenceModel(features=sorted(names))
        for whole in (True, False):
            draw = (lambda shape: rng.integers(-1, 2, shape).astype(float)) if whole else (lambda shape: rng.normal(size=shape))
            model.W, model.A = draw(model.W.shape), draw(model.A.shape)
            expected = {r.id: r.labels for r in SQ.decode(df, model, "tokens", lex, gaz).collect()}
            assert {r.id: r.labels for r in SQ.decode(df, model, "tokens", lex, gaz, batched=True).collect()} == expected
            decoder = batches.Decoder(model, SQ._RECORD, *SQ.known_words(lex, gaz))
            tokens = pa.array([t for _, t in rows], pa.list_(pa.string()))
            assert [len(tokens[a:b]) for a, b in batches.pieces(tokens, 60)] == [5, 1, 3]
            assert pa.concat_arrays([decoder(tokens[a:b]) for a, b in batches.pieces(tokens, 60)]).to_pylist() == [expected[i] for i, _ in rows]


def test_labelling_by_batch_is_far_faster_than_the_projection(spark):
    import time

    from pyspark.sql import functions as F
    df = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("w"), F.hash("id", i) % 5000)).alias("tokens")).repartition(4).localCheckpoint()
    model = SQ.SequenceModel(features=["bias", "length", "next:rawstring.end", "period"])
    model.W[:] = np.random.default_rng(1).normal(size=model.W.shape)

    def seconds(**how):
        took = []
        for _ in range(2):
            at = time.time()
            assert SQ.decode(df, model, **how).agg(F.sum(F.size("labels"))).first()[0] == 200_000
            took.append(time.time() - at)
        return min(took)

    assert 2 * seconds(batched=True) < seconds()


def test_walks_give_the_errors_of_single_texts():
    """Texts of many lengths side by side: the same loss, derivative and transitions, also where products run out of a double."""
    from wordloom.operators import batches
    rng = np.random.default_rng(7)
    ntok = np.array([3, 1, 0, 7, 7, 2, 40, 1])
    for spread in (1, 5000):
        E, A, y = rng.normal(size=(ntok.sum(), 4)) * spread, rng.normal(size=(4, 4)), rng.integers(0, 4, ntok.sum())
        loss, d, ga = SQ.label_errors(E, A, ntok, y)
        rows, sizes, _, _ = batches.packed(ntok)
        assert sorted(rows) == list(range(len(y))) and (batches.walk_errors(E[rows].T, A, sizes, y[rows], SQ.PRODUCT_RANGE) is None) == (spread > 1)
        got = SQ.walk_errors(np.ascontiguousarray(E[rows].T), A, sizes, y[rows])
        assert np.isclose(got[0], loss) and np.allclose(got[1], d[rows].T) and np.allclose(got[2], ga)
        assert [list(p) for p in np.split(batches.best_paths(E[rows].T.copy(), A, sizes)[np.argsort(rows)], np.cumsum(ntok)[:-1])] == [
            list(SQ.viterbi(e, A)) for e in np.split(E, np.cumsum(ntok)[:-1])]
