"""Readers (SRC-1 .. SRC-8).  Every reader returns a DataFrame.

All files are split over tasks, spreadsheet workbooks too (at the end of
their rows).  File order matters for some inputs (header row,
later-duplicate-wins); it is taken from the split's offset in the file and
from ``monotonically_increasing_id``, which increases with the file split and
the position inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.session import checked_broadcast, stage_path

WORK_ORDER_COLUMNS = ["address", "category", "description", "unit"]
LABELLED_COLUMNS = WORK_ORDER_COLUMNS + [("ent_description" if c == "description" else c)
                                         for c in fixed.LABELS] + [fixed.OBJECT2]

XML_CELL_SCHEMA = ("Cell array<struct<_Index: int, Data: struct<_VALUE: string, _Type: string>>>")


# ---------------------------------------------------------------------------
# SRC-1 / SRC-2: spreadsheet XML
# ---------------------------------------------------------------------------

def read_spreadsheet_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-1: one row per ``Row`` with ``file``, ``offset``, ``row_no`` and ``cells map<int, string>`` (1-based columns).

    Workbooks (UTF-8) are cut behind every ``</Row>``, so one file is read by
    many tasks; each record is parsed as XML by itself, with the name-space
    prefixes that it uses declared.  ``offset`` is where the split begins;
    (offset, row_no) is the order within a file.  ``ss:Index`` gaps are
    honoured: a cell with an index jumps to that column, the next cells
    follow it.  A record that is no XML has no cells.
    """
    text = spark.read.option("lineSep", "</Row>").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.split("value", r"<Row(?=[\s/>])").alias("v"))
    # in front of a row's own text there may be rows without content (<Row/>)
    each = text.select("file", "offset", F.explode(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))).alias("v"))
    prefixes = F.array_distinct(F.regexp_extract_all("v", F.lit(r"[<\s]([A-Za-z_][\w.-]*):[A-Za-z_]"), F.lit(1)))
    names = F.array_join(F.transform(F.filter(prefixes, lambda x: ~x.isin("xmlns", "xml")), lambda x: F.concat(F.lit(" xmlns:"), x, F.lit('="ns"'))), "")
    body = F.when(F.col("v").rlike(r"^[^>]*/>"), F.lit("<Row/>")).otherwise(F.concat(F.lit("<Row"), names, F.col("v"), F.lit("</Row>")))
    raw = each.select("file", "offset", F.monotonically_increasing_id().alias("row_no"),
                      F.from_xml(body, XML_CELL_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("r")).withColumn("Cell", F.col("r.Cell"))
    cells = F.coalesce(F.col("Cell"), F.array().cast(raw.schema["Cell"].dataType))
    init = F.named_struct(F.lit("last"), F.lit(0), F.lit("out"),
                          F.array().cast("array<struct<pos:int,value:string>>"))
    placed = F.aggregate(cells, init, lambda acc, c: F.named_struct(
        F.lit("last"), F.coalesce(c["_Index"], acc["last"] + 1),
        F.lit("out"), F.concat(acc["out"], F.array(F.named_struct(
            F.lit("pos"), F.coalesce(c["_Index"], acc["last"] + 1), F.lit("value"), c["Data"]["_VALUE"])))),
        lambda acc: acc["out"])
    return raw.select("file", "offset", "row_no", F.map_from_entries(placed).alias("cells"))


def read_spreadsheet_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first row of every file is its header; later rows become records named by their own file's header.

    Header rows are found per file (the least offset, then ``row_no``), so a
    folder of part files written in parallel reads back correctly and files
    may order their columns differently.  The columns are all names that
    some header has; a name that a file lacks is null for its rows.
    """
    # parsed once: the headers, their names and the records are read from what is stored
    stored = stage_path(spark, "spreadsheet-rows")
    read_spreadsheet_rows(spark, path).write.parquet(stored)
    rows = spark.read.parquet(stored)
    heads = rows.groupBy("file").agg(F.min_by(F.struct("offset", "row_no", "cells"), F.struct("offset", "row_no")).alias("h")) \
                .select("file", F.struct("h.offset", "h.row_no").alias("_h"), F.col("h.cells").alias("_names"))
    names = [r["n"] for r in heads.select(F.explode(F.map_values("_names")).alias("n")).where("n is not null")
             .distinct().orderBy("n").collect()]  # distinct column names
    # name -> cell of the record, by the header of the record's file
    body = rows.join(checked_broadcast(heads), "file").where(F.struct("offset", "row_no") > F.col("_h"))
    place = F.map_from_entries(F.transform(F.filter(F.map_entries("_names"), lambda e: e["value"].isNotNull()),
                                           lambda e: T.nstruct(k=e["value"], v=e["key"])))
    body = body.withColumn("_place", place)
    return body.select("file", "offset", "row_no", *[F.try_element_at("cells", F.try_element_at("_place", F.lit(n))).alias(n) for n in names])


def raw_to_work_orders(table: DataFrame, clean=None) -> DataFrame:
    """SRC-2 / CLN-7: pick address, category, description, unit by header name; CLN-1 on each field.

    ``clean`` is an optional ``DataFrame -> DataFrame`` applied to the
    description (e.g. ``operators.clean.preclean``).  Missing fields are ''.
    Rows without any of the fields are rejects (`raw_rejects`).
    """
    def field(name):
        return T.ascii_only(F.col(name)) if name in table.columns else F.lit("")
    wo = table.where(~_is_reject(table)).select(F.col("row_no").alias("row_id"), *[field(c).alias(c) for c in WORK_ORDER_COLUMNS])
    return clean(wo) if clean is not None else wo


def _is_reject(table: DataFrame):
    """A raw row that holds none of the work-order fields."""
    have = [F.col(c) for c in WORK_ORDER_COLUMNS if c in table.columns]
    return F.coalesce(*have).isNull() if have else F.lit(True)


def raw_rejects(table: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """SRC-2 side output: the raw rows that become no work order, with the reason and the columns ``also``."""
    keep = [c for c in ("file", "offset", "row_no", *also) if c in table.columns]
    return table.where(_is_reject(table)).select(*keep, F.lit("no work-order field").alias("reason"))


# ---------------------------------------------------------------------------
# SRC-3 / SRC-6: TSV tables
# ---------------------------------------------------------------------------

def read_work_orders(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: tab-separated, header, no quoting; blanks are ''; ``row_id`` in file order."""
    schema = T_.StructType([T_.StructField(c, T_.StringType()) for c in WORK_ORDER_COLUMNS])
    df = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema, mode="PERMISSIVE")
    return df.na.fill("").withColumn("row_id", F.monotonically_increasing_id())


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6 input: the 13-column labelled table (second ``description`` read as ``ent_description``)."""
    schema = T_.StructType([T_.StructField(c, T_.StringType()) for c in LABELLED_COLUMNS])
    df = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema)
    return df.na.fill("").withColumn("row_id", F.monotonically_increasing_id())


def labelled_entities(labelled: DataFrame) -> DataFrame:
    """SRC-6 + RSH-2: typed entities ``(row_id, type, entity, type_ord)`` of a labelled table."""
    from wordloom.operators.labels import columns_to_entities
    src = labelled.withColumnRenamed("description", "_wo_description").withColumnRenamed(
        "ent_description", "description")
    return columns_to_entities(src, "row_id")


# ---------------------------------------------------------------------------
# SRC-4 / SRC-5: training lines and synonym file
# ---------------------------------------------------------------------------

def read_training_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: ``(line_id, line)`` of a labelled comma file (no header, no quoting)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"),
                                        F.col("value").alias("line"))


def read_training_xml(spark: SparkSession, path: str) -> DataFrame:
    """The training XML back as ``(pairs array<struct<term, label>>)``, one row a sequence.

    Elements keep their order; a sequence is read as its text, so labels
    that repeat and any order of labels come back as written.
    """
    raw = spark.read.option("lineSep", "</TokenSequence>").text(path).select(F.element_at(F.split("value", "<TokenSequence>"), -1).alias("v"),
                                                                            F.contains("value", F.lit("<TokenSequence>")).alias("ok"))
    items = F.regexp_extract_all("v", F.lit(r"<([^<>/]+)>([^<]*)</"), F.lit(0))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return raw.where("ok").select(F.transform(items, lambda x: T.nstruct(
        term=plain(F.regexp_extract(x, r">([^<]*)</", 1)), label=F.regexp_extract(x, r"<([^<>/]+)>", 1))).alias("pairs"))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: ``(file, line_no, phrase, target)``: last tab field is the target (``_`` -> blank), the rest the phrase.

    ``line_no`` grows with the place in the file, so ``(file, line_no)`` is the files' line order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"),
                                         F.lower(F.col("value")).alias("v"))
    f = F.split("v", "\t")
    n = F.size(f)
    return lines.select("file", "line_no",
                        F.trim(F.array_join(F.slice(f, 1, F.greatest(n - 1, F.lit(0))), " ")).alias("phrase"),
                        F.replace(F.element_at(f, -1), F.lit("_"), F.lit(" ")).alias("target")) \
                .where(F.col("phrase") != "")


# ---------------------------------------------------------------------------
# SRC-7 / SRC-8: vectors
# ---------------------------------------------------------------------------

def read_word_vectors(spark: SparkSession, path: str, fmt: str = "parquet", normalize: bool = True) -> DataFrame:
    """SRC-7 (+ VEC-8): ``(term, vec)`` from Parquet or the word2vec text format.

    Text format: an optional ``count dim`` first line, then ``term v1 v2 ...``.
    """
    from wordloom.operators.vectors import normalized
    if fmt == "parquet":
        df = spark.read.parquet(path).select("term", "vec")
    else:
        parts = F.split(F.trim(F.col("value")), r"\s+")
        df = spark.read.text(path).select(F.get(parts, 0).alias("term"),
                                          F.slice(parts, 2, 1 << 20).alias("_v"))
        df = df.where(F.size("_v") > 1).select(
            "term", F.transform("_v", lambda x: x.try_cast("float")).alias("vec"))
    return df.withColumn("vec", normalized("vec")) if normalize else df


def read_entity_vectors_text(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """SRC-8 compatibility reader: ``type<TAB>entity<TAB>[ v v v ... ]`` records, brackets spanning lines.

    Records are cut at ``]`` + newline, so wrapped vectors reassemble and the
    last record is kept.  A value that is not a number makes the row's
    ``vec`` null (reported, not fatal).
    """
    recs = spark.read.option("lineSep", "]\n").text(path)
    if distinct:  # SET-2: identical records once
        recs = recs.distinct()
    body = F.regexp_replace(F.col("value"), r"^\s+|\]\s*$", "")
    f = F.split(body, "\t", 3)
    nums = F.split(F.trim(F.regexp_replace(F.get(f, 2), r"[\[\]]", " ")), r"\s+")
    vec = F.transform(nums, lambda x: x.try_cast("double"))
    out = recs.select(F.get(f, 0).alias("type"), F.get(f, 1).alias("entity"), vec.alias("vec"))
    out = out.where(F.col("type").isNotNull() & (F.col("type") != ""))
    return out.withColumn("vec", F.when(F.forall("vec", lambda x: x.isNotNull()), F.col("vec")))
