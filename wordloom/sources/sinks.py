"""Writers (SNK-1 .. SNK-6).  All writes are distributed: one part file per partition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import labels as L


def write_training_xml(parsed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: accepted lines as ``<TokenSequence>`` elements.

    Every part file is a complete ``<Collection>`` document: the wrapper
    lines are added per partition, so no single task sees all sequences.
    """
    ok = L.keep_rows(parsed, F.col("reason").isNull())
    lines = ok.select(L.training_xml(ok).alias("value"))

    def wrap(batches):
        yield pd.DataFrame({"value": ["<Collection>"]})
        for pdf in batches:
            yield pdf
        yield pd.DataFrame({"value": ["</Collection>"]})

    lines.mapInPandas(wrap, "value string").write.mode(mode).text(path)


def write_labelled(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2: tab-separated with header, no quoting."""
    df.write.mode(mode).csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def write_parse_log(df: DataFrame, line_col: str, tokens_col: str, labels_col: str, path: str,
                    mode: str = "overwrite") -> None:
    """SNK-3: ``line--> [["token","label"], ...]`` per input line."""
    pairs = F.transform(F.arrays_zip(F.col(tokens_col), F.col(labels_col)),
                        lambda z: F.array(z[tokens_col], z[labels_col]))
    df.select(F.concat(F.col(line_col), F.lit("--> "), F.to_json(pairs)).alias("value")).write.mode(mode).text(path)


def write_entity_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-4: ``(type, entity, vec)`` as Parquet partitioned by type (type filters prune directories)."""
    df.select("type", "entity", "vec").write.mode(mode).partitionBy("type").parquet(path)


# Text of a line that travels as one row of the report's writer.
REPORT_PIECE = 1 << 16


def cluster_report_pieces(members: DataFrame, type_col: str = "type", cluster_col: str = "cluster", member_col: str = "entity") -> DataFrame:
    """SNK-5 body: ``(type, value)`` rows whose values, joined by blanks, are the lines ``Cluster k: [a, b, c]`` of every type.

    Members are dealt by ranges of (type, cluster), sorted and streamed, so a
    line of any length is written piece by piece and no cluster is gathered.
    """
    def write(batches):
        here, piece, size, rows = None, [], 0, []
        for pdf in batches:
            for t, c, m in zip(pdf["t"], pdf["c"], pdf["m"]):
                if (t, c) != here:
                    # the blank behind a line's first word is the one that the writer puts between two rows
                    same = here is not None and here[0] == t
                    if here is not None:
                        rows.append((here[0], ", ".join(piece) + ("]\nCluster" if same else "]\n")))
                    here, piece, size = (t, c), [f"{'' if same else 'Cluster '}{c}: [{m}"], 0
                elif size > REPORT_PIECE:
                    rows.append((t, ", ".join(piece) + ","))
                    piece, size = [m], 0
                else:
                    piece.append(m)
                size += len(m) + 2
            if rows:
                yield pd.DataFrame(rows, columns=["t", "value"])
                rows = []
        if here is not None:
            yield pd.DataFrame([(here[0], ", ".join(piece) + "]\n")], columns=["t", "value"])

    m = members.select(F.col(type_col).alias("t"), F.col(cluster_col).cast("long").alias("c"), F.col(member_col).cast("string").alias("m")).where(F.col("m").isNotNull())
    kind = m.schema["t"].dataType.simpleString()
    return m.repartitionByRange("t", "c").sortWithinPartitions("t", "c", "m").mapInPandas(write, f"t {kind}, value string").withColumnRenamed("t", type_col)


def write_cluster_report(members: DataFrame, path: str, mode: str = "overwrite", **kw) -> None:
    """SNK-5: one folder per type, part files by ranges of clusters, lines sorted by cluster (a file ends with a blank)."""
    cluster_report_pieces(members, **kw).write.mode(mode).option("lineSep", " ").partitionBy(kw.get("type_col", "type")).text(path)


def write_gazetteers(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-6: mined ``(label, term, n)`` table as Parquet, ready for ``features.gazetteer_flags``."""
    L.gazetteer_mine(pairs).write.mode(mode).parquet(path)
