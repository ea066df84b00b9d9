"""Stage runner end to end and the streaming labeller, on tiny hand-made files."""

import os
import tempfile

import pytest

from wordloom.operators import features as FE
from wordloom.operators import labels as L
from wordloom.operators import lookup
from wordloom.operators import sequence as SQ
from wordloom.plans.pipeline import PipelineConfig, run_pipeline
from wordloom.streaming.labelling import WORK_ORDER_SCHEMA, start_labelling


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_pipeline_and_stream(spark):
    d = tempfile.mkdtemp()
    wo = write(os.path.join(d, "wo.tsv"), "address\tcategory\tdescription\tunit\n"
               "1 Main\tPlumbing\tfix kitchen sink\t3C\n2 Main\tDoors\treplace front door lock\t4A\n"
               "3 Main\tHeat\tbedrm heater\t\n")
    tr = write(os.path.join(d, "train.csv"), "\n".join(
        ["fix,action,kitchen,location,sink,object", "replace,action,front,description,door,,lock,object",
         "repair,action,bedroom,location,heater,object", "fix,action,bath,location,tub,object,,"] * 5) + "\n")
    vec = os.path.join(d, "vec")
    spark.createDataFrame([("sink", [1.0, 0.0]), ("door_lock", [0.0, 1.0]), ("heater", [1.0, 1.0]),
                           ("fix", [0.5, 0.5])], "term string, vec array<double>").write.parquet(vec)
    syn = write(os.path.join(d, "syn.tsv"), "bedrm\tbedroom\n")
    cfg = PipelineConfig(work_orders_tsv=wo, training_csv=tr, synonyms_tsv=syn, word_vectors=vec,
                         out_dir=os.path.join(d, "out"),
                         stages=["ingest", "train", "label", "vectorize", "cluster"])
    counters = {}
    done = run_pipeline(spark, cfg, counters)
    assert counters["work_orders"] == 3 and counters["labelled"] == 3
    lab = spark.read.parquet(done["labelled"]).orderBy("row_id").collect()
    assert len(lab) == 3
    assert lab[2]["description"] == "bedroom heater"
    assert lab[0]["object"] == "sink" and lab[0]["action"] == "fix"
    n_vec = spark.read.parquet(done["entity_vectors"]).count()
    assert n_vec >= 1
    assert counters["entities"] == n_vec + counters["entities.unresolved"]
    assert os.path.isdir(done["cluster_report"])
    # streaming: the same labelling over a folder of work-order files
    src = os.path.join(d, "stream_in")
    spark.read.parquet(done["work_orders"]).drop("row_id").write.parquet(src)
    model = SQ.SequenceModel.load(spark, done["model"])
    mined = spark.read.parquet(done["gazetteers"]).where("label in ('location', 'object')").selectExpr("label as kind", "term")
    gazetteer = FE.gazetteer_table(spark).unionByName(mined).distinct()
    q = start_labelling(spark, src, model, os.path.join(d, "stream_out"), os.path.join(d, "stream_ckpt"), gazetteer=gazetteer)
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(d, "stream_out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.read.parquet(done["labelled"]).select(*got.columns).collect()))


LEXICON = [("antique", "JJ", 0), ("fine", "JJ", 0), ("sink", "NN", 0), ("fix", "VB", 0), ("fix", "NN", 1)]


def pos_model():
    m = SQ.SequenceModel(features=["bias", "is_object", "nltk_tag:JJ", "nouns_count", "previous:verbs_count"])
    for name, label, w in (("bias", "noise", .5), ("nltk_tag:JJ", "description", 1.), ("nouns_count", "object", 1.), ("is_object", "object", 1.), ("previous:verbs_count", "location", .75)):
        m.W[m.features.index(name), m.labels.index(label)] = w
    return m


def test_stream_and_batch_give_the_same_labels(spark):
    d = tempfile.mkdtemp()
    lexicon = spark.createDataFrame(LEXICON, "word string, tag string, ord int")
    gazetteer = spark.createDataFrame([("object", "antique"), ("object", "it"), ("location", "attic")], "kind string, term string")
    orders = spark.createDataFrame([("a", "c", t, "") for t in ("fine antique", "fix the sink", "", None, "FIX Attic antique it")], WORK_ORDER_SCHEMA)
    orders.write.parquet(os.path.join(d, "in"))
    for lex, gaz in ((lexicon, gazetteer), (None, None)):
        batch = L.with_label_columns(SQ.label_tokens(orders.na.fill(""), "description", pos_model(), lex, gaz), "tokens", "labels")
        out = tempfile.mkdtemp()
        start_labelling(spark, os.path.join(d, "in"), pos_model(), os.path.join(out, "o"), os.path.join(out, "c"), lexicon=lex, gazetteer=gaz).awaitTermination(120)
        got = spark.read.parquet(os.path.join(out, "o"))
        want = {tuple(r) for r in batch.select(*got.columns).collect()}
        assert {tuple(r) for r in got.collect()} == want
        assert (len({r[got.columns.index("ent_description")] for r in want}) > 1) == (lex is not None)
    big = spark.range(lookup.DEFAULT_BROADCAST_ROWS + 1).selectExpr("concat('w', id) as word", "'NN' as tag")
    stream = spark.readStream.schema(WORK_ORDER_SCHEMA).parquet(os.path.join(d, "in"))
    with pytest.raises(ValueError, match="stream"):
        SQ.label_tokens(stream, "description", pos_model(), big)
