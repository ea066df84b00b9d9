"""Phrase substitution and spelling correction cases."""

from pyspark.sql import functions as F

from wordloom.operators import clean as CL


def run_phrases(spark, texts, entries, builtins=False):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    tab = CL.synonym_table(spark, entries, with_builtins=builtins)
    return {r.id: r.cleaned for r in CL.replace_phrases(df, "id", "t", tab).collect()}


def test_longest_first_and_shield(spark):
    got = run_phrases(spark, ["fix the a c unit.", "a c", "b a c"],
                      [("a c", "air conditioner"), ("a", "x"), ("conditioner", "NO"), ("b", "bee")])
    assert got == {0: "fix the air conditioner unit.", 1: "air conditioner", 2: "bee air conditioner"}


def test_case_punctuation_and_builtins(spark):
    texts = ["Pls check A/C.", "no match here", "a--b", "(bedrm)", "'bedrm'", "kitchen/bedrm", "bedrm-2", "x&amp;y", "bedrms", "--"]
    got = run_phrases(spark, texts, [], builtins=True)
    assert [got[i] for i in range(len(texts))] == [
        "please check AC.", "no match here", "a-b", "(bedroom)", "'bedroom'", "kitchen/bedroom", "bedroom-2", "xandy", "bedrms", "-"]


def test_synonym_file_comes_first_in_file_order(spark):
    import os
    import tempfile

    from wordloom.sources import readers as R
    d = tempfile.mkdtemp()
    for name, text in (("a.tsv", "pls\tfirst\nzz\tone\n"), ("b.tsv", "zz\ttwo\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    tab = CL.synonym_table(spark, [("zz", "three")], file_df=R.read_synonyms(spark, d).repartition(5))
    rows = {r.phrase: r for r in tab.collect()}
    assert rows["pls"].target == "please" and rows["pls"].place.source == 0   # first place, last target
    assert rows["zz"].target == "three" and rows["zz"].place.file.endswith("a.tsv")


def test_duplicate_phrase_last_target(spark):
    got = run_phrases(spark, ["tnk you"], [("tnk", "first"), ("tnk", "second")])
    assert got[0] == "second you"


def test_spelling(spark):
    dic = spark.createDataFrame([("leak", 10), ("water", 5), ("sink", 7), ("sunk", 7), ("heater", 3)],
                                "word string, freq long")
    words = spark.createDataFrame([(w,) for w in ["laek", "watr", "sinkk", "snk", "3rd", "...", "leak", "zzzzzz"]],
                                  "word string")
    got = {r.word: (r.correction, r.distance) for r in CL.spell_candidates(words, dic).collect()}
    assert got["laek"] == ("leak", 1)      # adjacent swap counts as one edit
    assert got["watr"] == ("water", 1)
    assert got["sinkk"] == ("sink", 1)
    assert got["snk"] == ("sink", 1)       # tie on distance and frequency -> smaller word
    assert "3rd" not in got and "..." not in got and "leak" not in got and "zzzzzz" not in got
    df = spark.createDataFrame([(1, "water laek under sink, 3rd floor")], "id long, t string")
    r = CL.spell_correct(df, "id", "t", dic).first()
    assert r.corrected == "water leak under sink , 3rd floor" and r.n_corrected == 1


def test_spelling_distance_two(spark):
    dic = spark.createDataFrame([("bathroom", 10), ("abc", 5), ("kitchen", 2)], "word string, freq long")
    words = ["bathrm", "bahtrom", "abthrooom", "ca", "kitcehn", "ktichne", "kxtxhxn", "x" * 40]
    got = {r.word: (r.correction, r.distance) for r in
           CL.spell_candidates(spark.createDataFrame([(w,) for w in words], "word string"), dic).collect()}
    assert got["bathrm"] == ("bathroom", 2)
    assert got["bahtrom"] == ("bathroom", 2)      # a swap and a deletion
    assert got["abthrooom"] == ("bathroom", 2)    # a swap and an insertion
    assert got["ca"] == ("abc", 2)                # a swap with a letter put between
    assert got["kitcehn"] == ("kitchen", 1)
    assert got["ktichne"] == ("kitchen", 2)       # two swaps
    assert "kxtxhxn" not in got and "x" * 40 not in got


def test_edit_distance_brute_force(spark):
    import itertools

    def neighbours(w):
        out = {w[:i] + w[i + 1:] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"}
        out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in "abc"}
        return out | {w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)}
    words = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("abc", repeat=n)][::3]
    rows = []
    for a in words:
        one = neighbours(a) - {a}
        two = set().union(*(neighbours(x) for x in one)) - one - {a}
        rows += [(a, b, 0 if a == b else 1 if b in one else 2 if b in two else None) for b in words]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    bad = df.where(~CL.edit_distance("a", "b", 2).eqNullSafe(df["d"])).collect()
    assert not bad, bad[:5]


def test_deletion_keys_miss_no_candidate(spark):
    """Words within two edits share a key, whatever the words' lengths."""
    import random
    rng = random.Random(6)
    rows = []
    for n in [1, 2, 3, 5, 6, 7, 8, 9, 12, 20] * 40:
        a = "".join(rng.choice("ab") for _ in range(n))
        b = a
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            kind = rng.randrange(4)
            b = [b[:i] + rng.choice("abc") + b[i:], b[:i] + b[i + 1:], b[:i] + rng.choice("abc") + b[i + 1:], b[:i] + b[i + 1:i + 2] + b[i:i + 1] + b[i + 2:]][kind]
        rows.append((a, b))
    df = spark.createDataFrame([r for r in rows if r[1]], "a string, b string")
    assert df.where(CL.edit_distance("a", "b", 2).isNull()).count() == 0
    assert df.where(~F.arrays_overlap(CL.deletion_keys("a", 2), CL.deletion_keys("b", 2))).count() == 0
    assert df.select(F.max(F.size(CL.deletion_keys("a", 2)))).first()[0] <= 29


def test_spelling_of_rows_that_share_an_id(spark):
    dic = spark.createDataFrame([("leak", 10), ("sink", 7)], "word string, freq long")
    df = spark.createDataFrame([(1, "laek here"), (1, "laek snik"), (2, None), (None, "snik")], "id long, t string")
    got = sorted((r.id or 0, r.corrected, r.n_words, r.n_corrected) for r in CL.spell_correct(df, "id", "t", dic).collect())
    assert got == [(0, "sink", 1, 1), (1, "leak here", 2, 1), (1, "leak sink", 2, 2), (2, "", 0, 0)]


def test_phrases_without_a_shuffle_of_texts(spark):
    """Each row by itself, whatever its id; empty targets and long texts with many matches."""
    tab = CL.synonym_table(spark, [("pls", "please"), ("uh", ""), ("a c", "air")], with_builtins=False)
    many = "Pls uh a c " * 2000
    df = spark.createDataFrame([(1, "pls now"), (1, "now a c pls"), (None, "pls"), (2, None), (3, ""), (4, many)], "id long, t string")
    r = CL.replace_phrases(df, "id", "t", tab)
    got = sorted((x.id or 0, x.cleaned or "") for x in r.collect())
    assert got == [(0, "please"), (1, "now air please"), (1, "please now"), (2, ""), (3, ""), (4, ("please air " * 2000).strip())]
    assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()


def test_phrases_from_a_table_too_large_for_a_literal(spark, monkeypatch):
    from wordloom.operators import lookup
    entries = [("a c", "air"), ("a", "x"), ("uh", "")]
    texts = ["A c uh b", "none", "a a c"]
    want = run_phrases(spark, texts, entries)
    monkeypatch.setattr(lookup, "literal_dictionary", lambda *a, **k: None)
    assert run_phrases(spark, texts, entries) == want == {0: "air b", 1: "none", 2: "x air"}


def test_corrections_are_joined_at_every_size(spark):
    """The lookup's plan doesn't depend on the number of corrections; equal texts and null words keep their rows."""
    dic = spark.createDataFrame([("leak", 10), ("sink", 7)], "word string, freq long")
    texts = ["laek here", "laek here", "snik , laek snik 3rd", "", None, "leak"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    r = CL.spell_correct(df, "id", "t", dic)
    got = {x.id: (x.corrected, x.n_words, x.n_corrected) for x in r.collect()}
    assert got == {0: ("leak here", 2, 1), 1: ("leak here", 2, 1), 2: ("sink , leak sink 3rd", 5, 3), 3: ("", 0, 0), 4: ("", 0, 0), 5: ("leak", 1, 0)}
    plan = r._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_phrases_by_batch_are_those_looked_up_by_expressions(spark, monkeypatch):
    """Overlaps, case, blanks, marks, null and empty targets: the same texts by batch and by lookup; by batch no expression walks a text's units."""
    import random
    rng = random.Random(3)
    entries = [("of the thing", None), ("a--b", "X"), ("the", None), ("(x)", ""), ("x", "yy"), ("of", "OF"), ("the of", "q"), ("é", "e"), ("- -", "="), ("on the", "onthe")]
    words = ["the", "of", "The", "x", "(x)", "a--b", "--", "-", "é", "É", " ", "\t", "thing", "on", "A/C", "pls", "."]
    texts = [None, "", " "] + ["".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for case_sensitive in (False, True):
        tab = CL.synonym_table(spark, entries, case_sensitive=case_sensitive)
        r = CL.replace_phrases(df, "id", "t", tab, case_sensitive=case_sensitive)
        assert "lambdafunction" not in r._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(CL, "bounded_rows", lambda *_: None)
            looked_up = CL.replace_phrases(df, "id", "t", tab, case_sensitive=case_sensitive).collect()
        assert {x.id: x.cleaned for x in r.collect()} == {x.id: x.cleaned for x in looked_up}


def test_candidates_are_those_of_all_pairs(spark):
    """Pairs left out before they are scored are none of the best: all pairs of random words, with swaps, give the same candidates."""
    import random
    rng = random.Random(5)

    def edited(w):
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w) - 1)
            w = rng.choice([w[:i] + w[i + 1] + w[i] + w[i + 2:], w[:i] + w[i + 1:] + "a", w[:i] + rng.choice("abcde") + w[i + 1:], w[:i] + "b" + w[i:]])
        return w

    known = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(60)})
    words = sorted({edited(w) for w in known for _ in range(4)} - set(known))
    dic = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(known)], "word string, freq long")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    pairs = df.crossJoin(dic.select(F.col("word").alias("cand"), "freq"))
    for most in (1, 2):
        far = pairs.withColumn("d", CL.edit_distance("word", "cand", most)).where("d is not null")
        expected = {r.word: tuple(r.b) for r in far.groupBy("word").agg(F.min(F.struct("d", (-F.col("freq")).alias("nf"), "cand")).alias("b")).collect()}
        got = {r.word: (r.distance, -r.freq, r.correction) for r in CL.spell_candidates(df, dic, most).collect()}
        assert got == expected and len(got) > 50


def test_corrected_texts_are_put_together_by_batch(spark):
    """A text of many corrected words: its words are not looked for in small maps by expressions."""
    known = [a + b + "xyzw" for a in "abcdefghij" for b in "klmnopqrst"]
    dic = spark.createDataFrame([(w, 5) for w in known], "word string, freq long")
    wrong = [w[:-2] + w[-1] + w[-2] for w in known]
    text = " , ".join(wrong * 20)
    df = spark.createDataFrame([(1, text), (2, text), (3, "(" + wrong[0] + ")\t" + wrong[1] + " é")], "id long, t string")
    r = CL.spell_correct(df, "id", "t", dic, max_distance=1)
    got = {x.id: (x.corrected, x.n_words, x.n_corrected) for x in r.collect()}
    assert got[1] == got[2] == (" , ".join(known * 20), 2 * 2000 - 1, 2000) and got[3] == (f"( {known[0]} ) {known[1]} é", 5, 2)
    assert "map_from_entries" not in r._jdf.queryExecution().optimizedPlan().toString()
