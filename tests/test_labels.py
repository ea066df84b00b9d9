"""Training lines, backfill, rejects, run merging and the label <-> column reshapes."""

from pyspark.sql import functions as F

from wordloom.operators import labels as L


def parse(spark, lines, mode="next"):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    p = L.parse_training_lines(df, "line", "line_id", mode=mode)
    pairs = {}
    for r in L.training_pairs(p).collect():
        pairs.setdefault(r.line_id, []).append((r.term, r.label))
    rejects = {r.line_id: r.reason for r in L.training_rejects(p).collect()}
    return pairs, rejects


def test_backfill_next_and_last(spark):
    line = "remove,action,smoke,,alarm,object,and,conjunction,install,action,combo,,alarm,object,,,"
    nxt, _ = parse(spark, [line])
    assert nxt[0][1] == ("smoke", "object") and nxt[0][5] == ("combo", "object")
    mixed = "a,,b,action,c,object"
    nxt, _ = parse(spark, [mixed])
    last, _ = parse(spark, [mixed], "last")
    assert nxt[0][0] == ("a", "action")
    assert last[0][0] == ("a", "object")


def test_rejects_and_typos(spark):
    lines = ["x,anlysis,y,object", "x,colour,y,object", "", "x,action,y,", ",,,"]
    pairs, rej = parse(spark, lines)
    assert pairs[0] == [("x", "analysis"), ("y", "object")]
    assert rej == {1: "bad_label", 2: "blank_line", 3: "unlabelled_term", 4: "blank_line"}


def test_group_merge_and_columns(spark):
    df = spark.createDataFrame([(1, ["fix", "smoke", "alarm", "in", "kitchen", "and", "door", "lock"],
                                 ["action", "object", "object", "noise", "location", "conjunction", "object", "object"])],
                               "id int, tokens array<string>, labels array<string>")
    runs = df.select(F.inline(L.merge_object_runs("tokens", "labels"))).collect()
    assert [(r.label, r.term) for r in runs if r.label == "object"] == [("object", "smoke alarm"), ("object", "door lock")]
    cols = L.with_label_columns(df, "tokens", "labels").first()
    assert cols["object"] == "smoke alarm" and cols["object2"] == "door lock"
    assert cols["action"] == "fix" and cols["location"] == "kitchen"
    # token conservation: the words of the label columns are the words of the text
    words = " ".join(cols[c] for c in ["location", "object", "action", "numerator", "analysis", "description",
                                       "conjunction", "noise", "object2"]).split()
    assert sorted(words) == sorted(["fix", "smoke", "alarm", "in", "kitchen", "and", "door", "lock"])
    g = df.select(F.inline(L.group_tags("tokens", "labels"))).collect()
    assert [r.label for r in g] == ["action", "object", "noise", "location", "conjunction"]
    assert g[1].text == "smoke alarm door lock"


def test_entities_and_dedupe(spark):
    df = spark.createDataFrame([(1, " sink ", "", "fix"), (2, "sink", "tap", "")],
                               "row_id long, object string, location string, action string")
    e = L.columns_to_entities(df, "row_id", types=["location", "object", "action"])
    assert sorted((r.row_id, r.type, r.entity) for r in e.collect()) == [
        (1, "action", "fix"), (1, "object", "sink"), (2, "location", "tap"), (2, "object", "sink")]
    d = L.first_seen(e, "entity", ["row_id", "type_ord"], ["type"]).collect()
    assert sorted((r.entity, r.row_id) for r in d) == [("fix", 1), ("sink", 1), ("tap", 2)]


def test_label_columns_of_odd_rows_are_those_of_the_runs(spark):
    """Null tokens, labels and rows, unequal lengths, patched and unknown labels: the columns that the run expressions give."""
    import random
    rng = random.Random(1)
    labels = ["object", "object", "noise", "description", "inspect", "decription", "object2", None, "other"]
    some = lambda of, n: None if rng.random() < 0.05 else [rng.choice(of) for _ in range(n)]
    rows = [(i, some(["a", "b", "", None], n), some(labels, n if rng.random() < 0.8 else rng.randint(0, 9))) for i, n in enumerate(rng.randint(0, 9) for _ in range(400))]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, labels array<string>")
    names = ["location", "object", "action", "numerator", "analysis", "description", "conjunction", "noise", "object2"]
    runs = df.select("id", L.label_runs("tokens", "labels").alias("r")).withColumn("r", L.second_objects("r"))
    terms_of = lambda c: F.array_join(F.transform(F.filter("r", lambda x: x["label"] == c), lambda x: x["term"]), " ").alias(c)
    expected = runs.select("id", *map(terms_of, names))
    got = L.with_label_columns(df, keep=["id"]).select("id", *names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
