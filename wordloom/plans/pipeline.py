"""PIPE-1: the stage runner.

Stages run in order and hand over through Parquet folders under one output
folder on shared storage (by default a fresh sub-folder of
``spark.checkpoint.dir``).  Every stage reads its input back from disk, so
a lost executor only re-runs part of the current stage, and each plan stays
short.

Stages: ``ingest`` (raw XML or work-order TSV -> cleaned work orders),
``train`` (training lines -> rejects, gazetteers, XML export, model),
``label`` (work orders -> 13-column labelled table), ``vectorize``
(labelled table -> entity vectors), ``cluster`` (entity vectors -> cluster
members and report).  The default run is ingest -> train -> label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.operators import clean as CL
from wordloom.operators import cluster as C
from wordloom.operators import features as FE
from wordloom.operators import labels as L
from wordloom.operators import sequence as SQ
from wordloom.operators import vectors as V
from wordloom.session import first_rows, stage_path
from wordloom.sources import readers as R
from wordloom.sources import sinks as K

DEFAULT_STAGES = ["ingest", "train", "label"]


@dataclass
class PipelineConfig:
    raw_xml: str | list[str] | None = None
    work_orders_tsv: str | None = None
    training_csv: str | None = None
    synonyms_tsv: str | None = None
    dictionary: str | None = None          # Parquet (word, freq)
    word_vectors: str | None = None        # Parquet (term, vec) or word2vec text
    word_vectors_format: str = "parquet"
    out_dir: str | None = None
    stages: list[str] = field(default_factory=lambda: list(DEFAULT_STAGES))
    row_limit: int = 0                     # ORD-2; 0 means no limit
    cluster_types: list[str] = field(default_factory=list)  # ORD-3; [] = all
    lexicon: str | None = None             # Parquet (word, tag[, ord]) for the POS features
    optional_features: list[str] = field(default_factory=list)  # FEA-9 names, see functions.shape
    tolerance: float = 1e-3                # fitting ends when the loss falls by less than this share
    max_distance: int = 2
    backfill: str = "next"


def run_pipeline(spark: SparkSession, cfg: PipelineConfig, counters: dict | None = None) -> dict[str, str]:
    """Run the configured stages; returns the folder of every written output.

    ``counters`` (AGG-9), when given, receives row counts observed while the
    stages write (``DataFrame.observe``: counted during the write itself, no
    extra pass over the data).
    """
    out = (cfg.out_dir or stage_path(spark, "pipeline")).rstrip("/")
    done: dict[str, str] = {}
    observed: dict[str, Observation] = {}

    def counted(df, name, *extra):
        ob = Observation(name)
        observed[name] = ob
        return df.observe(ob, F.count(F.lit(1)).alias("rows"), *extra)

    def p(name):
        done[name] = f"{out}/{name}"
        return done[name]

    lexicon = spark.read.parquet(cfg.lexicon) if cfg.lexicon else None

    def gazetteers():
        """The fixed lists and the locations and objects mined from the training lines."""
        mined = spark.read.parquet(done.get("gazetteers") or f"{out}/gazetteers")
        mined = mined.where(F.col("label").isin("location", "object")).select(F.col("label").alias("kind"), "term")
        return FE.gazetteer_table(spark).unionByName(mined).distinct()

    for stage in cfg.stages:
        if stage == "ingest":
            if cfg.raw_xml:
                table = R.read_spreadsheet_table(spark, cfg.raw_xml)
                counted(R.raw_rejects(table), "raw_rejects").write.mode("overwrite").parquet(p("raw_rejects"))
                wo = R.raw_to_work_orders(table)
            else:
                wo = R.read_work_orders(spark, cfg.work_orders_tsv)
            if cfg.synonyms_tsv or cfg.dictionary:
                # row_id is numbered by the reader: fixed on disk before it is joined on
                path = stage_path(spark, "work-orders-read")
                wo.write.parquet(path)
                wo = spark.read.parquet(path)
                phrases = CL.synonym_table(spark, file_df=R.read_synonyms(spark, cfg.synonyms_tsv)
                                           if cfg.synonyms_tsv else None)
                dic = spark.read.parquet(cfg.dictionary) if cfg.dictionary else None
                cleaned = CL.replace_phrases(wo, "row_id", "description", phrases, out="_d")
                if dic is not None:
                    cleaned = CL.spell_correct(cleaned.select("row_id", "_d"), "row_id", "_d", dic,
                                               cfg.max_distance, out="_d").join(wo.drop("description"), "row_id")
                wo = cleaned.drop("description").withColumnRenamed("_d", "description")
            counted(wo.select("row_id", *R.WORK_ORDER_COLUMNS), "work_orders").write.mode("overwrite") \
                .parquet(p("work_orders"))
        elif stage == "train":
            lines = R.read_training_lines(spark, cfg.training_csv)
            parsed = L.parse_training_lines(lines, "line", "line_id", mode=cfg.backfill)
            parsed.write.mode("overwrite").parquet(p("training_parsed"))
            parsed = spark.read.parquet(done["training_parsed"])
            L.training_rejects(parsed).select("line_id", "line", "reason").write.mode("overwrite").parquet(p("rejects"))
            K.write_training_xml(parsed, p("training_xml"))
            K.write_gazetteers(L.training_pairs(parsed), p("gazetteers"))
            model = SQ.fit(SQ.training_sequences(parsed), tolerance=cfg.tolerance, lexicon=lexicon, optional=cfg.optional_features, gazetteer=gazetteers())
            model.save(spark, p("model"))
        elif stage == "label":
            wo = spark.read.parquet(done.get("work_orders") or f"{out}/work_orders")
            if cfg.row_limit and cfg.row_limit > 0:
                wo = first_rows(wo, "row_id", cfg.row_limit)
            model = SQ.SequenceModel.load(spark, done.get("model") or f"{out}/model")
            lab = SQ.label_tokens(wo, "description", model, lexicon, gazetteers())
            cols = L.with_label_columns(lab, "tokens", "labels")
            counted(cols, "labelled").write.mode("overwrite").parquet(p("labelled"))
            K.write_labelled(spark.read.parquet(done["labelled"]).drop("row_id"), p("labelled_tsv"))
        elif stage == "vectorize":
            lab = spark.read.parquet(done.get("labelled") or f"{out}/labelled")
            ents = R.labelled_entities(lab)
            idf = V.idf_by_type(ents, "type", "entity")
            first = L.first_seen(ents, "entity", ["row_id", "type_ord"], ["type"]) \
                     .withColumn("id", F.col("entity"))  # unique here, and the same in every run
            wv = R.read_word_vectors(spark, cfg.word_vectors, cfg.word_vectors_format)
            res = V.resolve_entities(first.select("id", "type", "entity"), wv, idf)
            # Q9: unresolved entities are counted (observed before the filter), not written
            res = counted(res, "entities", F.sum((F.col("method") == "none").cast("int")).alias("unresolved"))
            K.write_entity_vectors(res.where(F.col("vec").isNotNull()), p("entity_vectors"))
        elif stage == "cluster":
            ev = spark.read.parquet(done.get("entity_vectors") or f"{out}/entity_vectors")
            assign = C.kmeans_by_type(ev, "type", "entity", "vec", types=cfg.cluster_types or None)
            assign.write.mode("overwrite").parquet(p("clusters"))
            members = C.cluster_members(spark.read.parquet(done["clusters"]))
            K.write_cluster_report(members, p("cluster_report"))
        else:
            raise ValueError(f"unknown stage {stage!r}")
    if counters is not None:
        for name, ob in observed.items():
            got = ob.get
            counters[name] = got.get("rows")
            for k, v in got.items():
                if k != "rows":
                    counters[f"{name}.{k}"] = v
    return done
