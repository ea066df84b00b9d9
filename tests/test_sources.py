"""Readers and writers on small hand-made files."""

import os
import tempfile

from pyspark.sql import functions as F

from wordloom.sources import readers as R
from wordloom.sources import sinks as K
from wordloom.session import first_rows

NS = "urn:schemas-microsoft-com:office:spreadsheet"


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_spreadsheet_xml(spark):
    d = tempfile.mkdtemp()
    cells = lambda vals: "".join(v for v in vals)
    x = (f'<?xml version="1.0"?><Workbook xmlns="{NS}" xmlns:ss="{NS}"><Worksheet><Table>'
         '<Row><Cell><Data ss:Type="String">id</Data></Cell><Cell><Data ss:Type="String">address</Data></Cell>'
         '<Cell><Data ss:Type="String">unit</Data></Cell><Cell><Data ss:Type="String">category</Data></Cell>'
         '<Cell><Data ss:Type="String">description</Data></Cell></Row>'
         '<Row><Cell><Data ss:Type="Number">1</Data></Cell><Cell><Data ss:Type="String">1 Main St</Data></Cell>'
         '<Cell><Data ss:Type="String">3C</Data></Cell><Cell><Data ss:Type="String">Plumbing</Data></Cell>'
         '<Cell><Data ss:Type="String">Leak ünder sink</Data></Cell></Row>'
         '<Row><Cell><Data ss:Type="Number">2</Data></Cell><Cell ss:Index="4"><Data ss:Type="String">Heat</Data></Cell>'
         '<Cell><Data ss:Type="String">no heat</Data></Cell></Row>'
         '<Row><Cell><Data ss:Type="Number">3</Data></Cell></Row>'
         '</Table></Worksheet></Workbook>')
    write(os.path.join(d, "a.xml"), x)
    wo = R.raw_to_work_orders(R.read_spreadsheet_table(spark, d)).orderBy("row_id").collect()
    assert [(r.address, r.category, r.description, r.unit) for r in wo] == [
        ("1 Main St", "Plumbing", "Leak nder sink", "3C"), ("", "Heat", "no heat", "")]


def test_vector_text_and_synonyms(spark):
    d = tempfile.mkdtemp()
    write(os.path.join(d, "v.txt"), "object\tsink\t[ 0.1 0.2\n  0.3]\nobject\ttap\t[ 1 2 3]\nlocation\tbad\t[ 1 x 3]\n")
    got = {r.entity: r.vec for r in R.read_entity_vectors_text(spark, d).collect()}
    assert got == {"sink": [0.1, 0.2, 0.3], "tap": [1.0, 2.0, 3.0], "bad": None}
    s = tempfile.mkdtemp()
    write(os.path.join(s, "s.tsv"), "A\tC\tair_con\n\tskip\nbedrm\tbedroom\n")
    syn = R.read_synonyms(spark, s).orderBy("line_no").collect()
    assert [(r.phrase, r.target) for r in syn] == [("a c", "air con"), ("bedrm", "bedroom")]


def test_tsv_round_trip(spark):
    out = os.path.join(tempfile.mkdtemp(), "lab")
    cols = R.LABELLED_COLUMNS
    df = spark.createDataFrame([tuple(["x"] * 4 + ["kitchen", "sink", "fix", "", "", "leaky", "", "", ""])],
                               ", ".join(f"{c} string" for c in cols))
    K.write_labelled(df, out)
    back = R.read_labelled(spark, out).first()
    assert back["location"] == "kitchen" and back["numerator"] == "" and back["ent_description"] == "leaky"
    ents = sorted((r.type, r.entity) for r in R.labelled_entities(R.read_labelled(spark, out)).collect())
    assert ents == [("action", "fix"), ("description", "leaky"), ("location", "kitchen"), ("object", "sink")]


def test_headers_per_file_and_rejects(spark):
    d = tempfile.mkdtemp()
    row = lambda vals: "<Row>" + "".join(f'<Cell><Data ss:Type="String">{v}</Data></Cell>' for v in vals) + "</Row>"
    for name, rows in (("a.xml", [("id", "address", "category", "description"), ("1", "1 Main", "Heat", "no heat")]),
                       ("b.xml", [("description", "category", "id", "address"), ("leak", "Plumbing", "2", "2 Main"), ()])):
        write(os.path.join(d, name), f'<?xml version="1.0"?><Workbook xmlns="{NS}" xmlns:ss="{NS}"><Worksheet><Table>'
              + "".join(map(row, rows)) + "</Table></Worksheet></Workbook>")
    table = R.read_spreadsheet_table(spark, d)
    got = sorted((r.address, r.category, r.description, r.unit) for r in R.raw_to_work_orders(table).collect())
    assert got == [("1 Main", "Heat", "no heat", ""), ("2 Main", "Plumbing", "leak", "")]
    assert [r.reason for r in R.raw_rejects(table).collect()] == ["no work-order field"]


def test_malformed_bytes_do_not_fail(spark):
    from wordloom.functions import text as T
    df = spark.createDataFrame([(bytearray(b"caf\xc3\xa9 \xff x"),)], "b binary")
    assert df.select(T.decode_utf8("b").alias("t")).first()["t"] == "caf\u00e9 \ufffd x"


def test_one_workbook_in_many_tasks(spark):
    """A file is cut at its rows; entities, gaps, prefixes, blank rows and rich text survive."""
    d = tempfile.mkdtemp()
    cell = lambda v, more="": f'<Cell{more}><Data ss:Type="String">{v}</Data></Cell>'
    rows = ['<Row ss:AutoFitHeight="0">' + "".join(map(cell, ("id", "address", "category", "description"))) + "</Row>"]
    for i in range(3000):
        if i % 100 == 7:
            rows.append('<Row ss:Height="3"/>')
        if i % 100 == 50:
            rows.append(f"<Row>\n {cell(i)}{cell('gap &#233; &amp;', ' ss:Index=&quot;4&quot;'.replace('&quot;', chr(34)))}</Row>")
        else:
            rows.append(f'<Row x:y="1">{cell(i)}{cell(f"{i} &lt;Main&gt; St", chr(32) + "ss:StyleID=" + chr(34) + "s1" + chr(34))}{cell("Heat")}{cell("no heat")}</Row>')
    write(os.path.join(d, "a.xml"), f'<?xml version="1.0"?><Workbook xmlns="{NS}" xmlns:ss="{NS}" xmlns:x="u"><Styles/><Worksheet><Table>\n' + "\n".join(rows) + "</Table></Worksheet></Workbook>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        table = R.read_spreadsheet_table(spark, d)
        assert R.read_spreadsheet_rows(spark, d).rdd.getNumPartitions() > 5
        got = sorted((int(r.id), r.address, r.category, r.description) for r in table.where("id is not null").collect())
        assert R.raw_rejects(table).count() == 30
        order = [r.id for r in table.where("id is not null").orderBy("offset", "row_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, None, None, "gap é &") if i % 100 == 50 else (i, f"{i} <Main> St", "Heat", "no heat") for i in range(3000)]
    assert order == [str(i) for i in range(3000)]


def test_cluster_report_lines_cross_batches(spark):
    rows = [("a", 0, f"member {i:05}") for i in range(12_000)] + [("a", 3, "x"), ("a", 3, "w"), ("b b", 1, "one"), ("b b", 1, None)]
    df = spark.createDataFrame(rows, "type string, cluster int, entity string").repartition(7)
    assert max(len(r.value) for r in K.cluster_report_pieces(df).collect()) < 2 * K.REPORT_PIECE
    path = os.path.join(tempfile.mkdtemp(), "report")
    K.write_cluster_report(df, path)
    lines = sorted((r.type, r.value) for r in spark.read.text(path).collect() if r.value.strip())
    assert lines == [("a", "Cluster 0: [" + ", ".join(f"member {i:05}" for i in range(12_000)) + "]"), ("a", "Cluster 3: [w, x]"), ("b b", "Cluster 1: [one]")]


def test_first_rows_without_a_sort(spark):
    values = [5, -3, 9_000_000_000, 7, 7, 7, None, 0, 12, -9_000_000_000]
    df = spark.createDataFrame([(v, "x") for v in values], "k long, t string").repartition(3)
    known = sorted(v for v in values if v is not None)
    for n in range(13):
        for ranges in (2, 1024):
            cut = first_rows(df, "k", n, ranges)
            assert sorted((r.k for r in cut.collect()), key=lambda v: (v is None, v)) == (known + [None])[:n]
    plan = first_rows(df, "k", 4)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    assert first_rows(df.where("k is null"), "k", 5).count() == 1 and first_rows(df.limit(0), "k", 5).count() == 0


def test_spreadsheets_are_parsed_once(spark, tmp_path):
    """Reading a table or its rejects parses no XML again, and rejects carry the columns asked for without a join."""
    d = str(tmp_path / "wb")
    cell = lambda v: f"<Cell><Data>{v}</Data></Cell>"
    rows = ["".join(cell(v) for v in ("id", "address", "description"))] + [cell(i) + (cell(f"a{i}") if i % 3 else "") for i in range(7)]
    spark.createDataFrame([("<Workbook><Table>" + "".join(f"<Row>{r}</Row>" for r in rows) + "</Table></Workbook>",)], "value string").coalesce(1).write.text(d)
    table = R.read_spreadsheet_table(spark, d)
    bad = R.raw_rejects(table, ("id",))
    assert sorted(r.id for r in bad.collect()) == ["0", "3", "6"]
    for df, joins in ((table, 1), (bad, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "from_xml" not in plan.lower() and "xmltostructs" not in plan.lower() and plan.count("Join") == joins
