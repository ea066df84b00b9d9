"""The classifier's held-out accuracy and edge cases; the pipeline's stages on a small folder."""

import os
import random
import tempfile
import zlib

import numpy as np

import corpus_pipeline
from wordloom.llm import stages, toxicity

BAD = ["idiot", "scum", "loser", "ekelhaft", "affreux"]


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.choice(['en', 'ta', 'ri', 'os'])}{rng.choice(['', 'x', 'y', 'zu'])}" for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        texts.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return texts, labels


def test_scores_on_held_out_rows(spark, docs):
    texts, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "Idiot, SCUM! you loser. " + "en " * 300_000), (1003, "12 34 !!")]
    df = docs([*texts, *extra], extra=True)
    model = toxicity.train(df, spark.createDataFrame([*labels, (2000, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.id: r.score for r in toxicity.score_documents(df, model).collect()}
    assert len(got) == len(texts) + len(extra) and all(0 <= s <= 1 for s in got.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in held]) >= 0.95
    assert got[1000] == got[1001] == got[1003] < 0.5 <= got[1002]
    by_column = {r.doc_id: r.s for r in toxicity.with_score(df, model, "s").collect()}
    assert all(abs(by_column[i] - s) < 1e-6 for i, s in got.items())


def test_only_labelled_texts_are_shuffled(spark):
    """Few labels are shuffled like many, and texts without a label are ruled out before."""
    texts = spark.createDataFrame([*((i, f"text {i}") for i in range(2000)), (7, "again"), (None, "no id")], "id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(0, 2000, 100)] + [(7, 1), (5000, 0)], "id long, y int")
    got = toxicity.labelled_texts(texts, y)
    assert sorted((r.id, r.text, r.y) for r in got.collect()) == sorted([*((i, f"text {i}", i % 2) for i in range(0, 2000, 100)), (7, "text 7", 1), (7, "again", 1)])
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan and "ArrowEvalPython" in plan


def test_held_out_rule(spark):
    ids = spark.range(300)
    got = {r.id: r.h for r in ids.select("id", toxicity.held_out(ids["id"]).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}


def test_without_labels_every_score_is_the_prior(spark, docs):
    df = docs(["a b", None])
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score_documents(df, model).collect()}) == 1
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_all_labelled_documents_are_learnt_from(spark, docs):
    """More documents than a bounded sample would take, and texts of over 1,500 words: each pair of documents has a word of its own, that the model must know."""
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    own = {i: "q" + "".join(chr(97 + int(c)) for c in str(k // 2)) for k, i in enumerate(ids)}
    texts = [(i, f"{own[i]} some words here") for i in ids[:-2]] + [(i, own[i] + " long" * 2000) for i in ids[-2:]]
    kept = spark.createDataFrame(texts, "doc_id long, text string")
    y = spark.createDataFrame([(i, k % 50 == 0) for k, i in enumerate(ids)], "doc_id long, bad boolean").selectExpr("doc_id", "int(bad) as toxic")
    aside = {r.doc_id for r in y.where("pmod(xxhash64(doc_id, 23), 5) = 0").collect()}
    model = toxicity.train(kept, y)
    shown = [i for i in ids if i not in aside]
    pairs = {own[i] for i in shown if sum(own[j] == own[i] for j in ids[max(0, ids.index(i) - 1):ids.index(i) + 2] if j not in aside) == 2}
    word, _, _ = toxicity.tokens(toxicity.word_hasher(), [" ".join(sorted(pairs)).encode()])
    assert len(word) == len(pairs) > 2000 and np.isin(word, model.word_keys).all()


def test_shards_learn_one_model(spark, docs):
    """Five shards and more, their means: as good on held-out rows as one shard; cuts come from all documents set aside."""
    texts, labels = corpus(900, seed=3)
    df = docs(texts, extra=True).repartition(8)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.FitSizes(shard_docs=120))
    got = {r.id: r.score for r in toxicity.score_documents(df, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in held]) >= 0.95


def test_a_long_text_is_learnt_in_pieces():
    rng = np.random.default_rng(5)
    m = toxicity.new_model(np.arange(1, 50, dtype=np.uint32), np.arange(1, 50, dtype=np.uint32))
    w = rng.integers(0, 50, 3 * toxicity.STEP_WORDS + 1).astype(np.uint32)
    padded = m.padded(*m.rows(w, w), np.array([0, len(w)]))
    best, top = toxicity._tops(m, *padded)
    for z, b, t in zip(m.responses(*padded[:2], padded[3]), best, top):
        assert (z.argmax(0) == t[0]).all() and (z.max(0) == b[0]).all()


def test_windows_stay_in_their_text():
    rng = np.random.default_rng(0)
    m = toxicity.TextCnn(np.arange(1, 9, dtype=np.uint32), np.zeros(0, np.uint32), rng.normal(size=(9, 4)).astype(np.float32), np.zeros((1, 4), np.float32))
    m.word_rows[0] = 0
    m.filters = [rng.normal(size=(k, 4, 3)).astype(np.float32) for k in toxicity.WIDTHS]
    m.bias = [np.zeros(3, np.float32) for _ in toxicity.WIDTHS]
    m.out = rng.normal(size=10).astype(np.float32)
    word, first = np.array([1, 2, 3, 4, 5], np.uint32), np.array([0, 3, 3, 5])
    raw = m.raw(word, np.zeros(5, np.uint32), first)
    # Each text alone gives the same; a window never reaches into the next text.
    for i in range(3):
        own = word[first[i]:first[i + 1]]
        assert np.allclose(m.raw(own, np.zeros(len(own), np.uint32), np.array([0, len(own)])), raw[i:i + 1], atol=1e-5)
    best = [max(sum(m.word_rows[x] @ f[j] for j, x in enumerate((list(own) + [0, 0, 0])[s:s + len(f)]))[c] for s in range(len(own)))
            for f in m.filters for c in range(3) for own in [word[:3]]]
    assert abs(np.maximum(best, 0) @ m.out[:-1] + m.out[-1] - raw[0]) < 1e-4


def write_folder(spark, docs):
    texts, labels = corpus()
    clean = [t for (_, t), (_, y) in zip(texts, labels) if not y]
    rows = [*texts, (600, clean[0]), (601, clean[1] + " extra"), (602, "my password = hunter2222 stays here with some more words around"),
            (603, "line one of the header text here\n" + clean[2][:40] + " own words one"), (604, "line one of the header text here\nanother own tail"),
            (605, None), (606, "")]
    d = tempfile.mkdtemp()
    docs(rows).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    return d, dict(rows), dict(labels)


def test_pipeline(spark, docs):
    d, rows, labels = write_folder(spark, docs)
    df = spark.read.parquet(f"{d}/documents.parquet")
    names = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in df.collect()}
        out = stage(spark, df, d)
        assert out.columns == names, name
        path = os.path.join(d, name)
        out.write.parquet(path)
        df = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in df.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            wrong = [i for i in labels if (i in after) == (labels[i] == 1)]
            assert len(wrong) <= 0.05 * len(labels) and {600, 602, 603, 604, 605, 606} <= set(after)
        elif name == "line_dedup":
            assert set(after) == set(before)
            assert after[600] == "" and after[604] == "another own tail" and after[603].startswith("line one") and after[605] is None
        elif name == "simhash_dedup":
            assert {600, 604} <= set(after) and not {605, 606} & set(after)      # empty texts and nulls are one group
        elif name == "secret_scan":
            assert after[602] == f"my {stages.REDACTED} stays here with some more words around"
            assert {i: t for i, t in after.items() if i != 602} == {i: t for i, t in before.items() if i != 602}
    packed = corpus_pipeline.STAGES[-1][1](spark, df, d).toPandas()
    assert set(packed.doc_id) == set(after)
    assert packed.n_tokens.sum() == sum(len((t or "").split()) for t in after.values())
    assert corpus_pipeline.run(spark, d).count() == len(packed)
