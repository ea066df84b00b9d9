"""Labelling as a Structured Streaming query.

Every step from cleaning to the entity columns is per row (no state), so
the same transforms run under ``readStream``: new work-order files are
tokenised, labelled with a fitted model and pivoted to the 13-column table,
micro-batch by micro-batch, with exactly-once file output through the
checkpoint location.  Lexicon, gazetteers and model are looked up within the
row (see `operators.lookup`), so a stream and a batch run give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators import labels as L
from wordloom.operators import sequence as SQ
from wordloom.sources.readers import WORK_ORDER_COLUMNS

WORK_ORDER_SCHEMA = ", ".join(f"{c} string" for c in WORK_ORDER_COLUMNS)


def labelled_stream(spark: SparkSession, source: str, model: SQ.SequenceModel, fmt: str = "parquet",
                    schema: str = WORK_ORDER_SCHEMA, options: dict | None = None,
                    lexicon: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """Streaming DataFrame of labelled work orders read from a folder of new files.

    ``lexicon`` and ``gazetteer`` must be the ones that the model was fitted
    with; they are read when the query starts and must be of bounded size.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    src = reader.load(source).na.fill("")
    lab = SQ.label_tokens(src, "description", model, lexicon, gazetteer)
    return L.with_label_columns(lab, "tokens", "labels")


def start_labelling(spark: SparkSession, source: str, model: SQ.SequenceModel, sink: str, checkpoint: str,
                    fmt: str = "parquet", sink_format: str = "parquet", available_now: bool = True,
                    **kw) -> StreamingQuery:
    """Start the query; ``available_now`` processes what is there and stops (batch-like runs)."""
    w = labelled_stream(spark, source, model, fmt, **kw).writeStream.format(sink_format) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink)
