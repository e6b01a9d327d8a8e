"""Readers, guards, catalog and streams."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewise.sources import catalog, files, sql, workbooks
from tablewise.streaming import monitors


def write(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as handle:
        handle.write(data)
    return path


@pytest.mark.parametrize("text, encoding, delimiter, expected", [
    ("a;b\n1;x\n2;città\n", "utf-8", ";", "UTF-8"), ("a,b\n1,x\n2,y\n", "utf-8", ",", "UTF-8"), ("a\tb\n1\tcittà €\n2\tx\n", "cp1252", "\t", "windows-1252"),
    ("a|b\n1|citt\x81\n2|x\n", "latin-1", "|", "ISO-8859-1"), ("a;b\n1;x\n2;y\n", "utf-8-sig", ";", "UTF-8"),
])
def test_sniffing(spark, tmp_path, text, encoding, delimiter, expected):
    path = write(tmp_path, "t.csv", text.encode(encoding))
    fmt = files.sniff_csv(spark, path)
    assert (fmt.encoding, fmt.delimiter) == (expected, delimiter)
    df, _fmt = files.guarded_csv(spark, path, max_rows=10)
    rows = df.orderBy("a").collect()
    assert df.columns == ["a", "b"] and [r.a for r in rows] == [1, 2]
    first, second = [line.split(delimiter)[1] for line in text.splitlines()[1:]]
    assert [r.b for r in rows] == [first, second]


def test_folder_of_unlike_files(spark, tmp_path):
    folder = tmp_path / "in put.csv"
    folder.mkdir()
    write(folder, "1.csv", "id;name\n1;a,b\n2;c\n".encode())
    write(folder, "2 b.csv", 'id,name\n3,"x;y;z"\n4,d\n'.encode())
    write(folder, "3.csv", "id;name\n5;città\n".encode("cp1252"))
    write(folder, "4.csv", b"")
    df, fmt = files.guarded_csv(spark, str(folder), max_rows=5)
    assert sorted(map(tuple, df.collect())) == [(1, "a,b"), (2, "c"), (3, "x;y;z"), (4, "d"), (5, "città")] and len(fmt.warnings) == 2
    with pytest.raises(ValueError, match="more than 4"):
        files.guarded_csv(spark, str(folder), max_rows=4)
    with pytest.raises(ValueError, match="delimiters.*1.csv"):
        files.sniff_csv(spark, str(folder))
    write(folder, "5.csv", b"id;other\n6;x\n")
    with pytest.raises(ValueError, match="different columns.*5.csv"):
        files.guarded_csv(spark, str(folder), max_rows=10)


def test_delimiter_of_late_lines(spark, tmp_path):
    text = "a;b\n" + "1,5;x,y\n" * 300 + "2;z\n" * 3000
    assert files.sniff_csv(spark, write(tmp_path, "t.csv", text.encode())).delimiter == ";"
    quoted = 'a,b\n"x\ny",1\n"p;q;r",2\n'
    df, _fmt = files.guarded_csv(spark, write(tmp_path, "q.csv", quoted.encode()), max_rows=3)
    assert _fmt.delimiter == ","


@pytest.mark.parametrize("data, message", [(b"", "empty"), (b"a,a\n1,2\n", "duplicate"), (b"a,b\n", "no rows"), (b"a\n1\n2\n3\n", "more than")])
def test_guards(spark, tmp_path, data, message):
    with pytest.raises(ValueError, match=message):
        files.guarded_csv(spark, write(tmp_path, "t.csv", data), max_rows=2)
    with pytest.raises(ValueError, match="supported"):
        files.guarded_csv(spark, write(tmp_path, "t.pdf", b"x"), max_rows=2)


def workbook(rows):
    cells = "".join(
        "<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{n}"><v>{v}</v></c>'
                           for i, v in enumerate(row) if v is not None) + "</row>"
        for n, row in enumerate(rows, 1))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return buffer.getvalue()


def test_workbooks(spark, tmp_path):
    write(tmp_path, "one.xlsx", workbook([["name", "n"], ["a", 1], ["b", None]]))
    write(tmp_path, "two.xlsx", workbook([["name", "n"], [None, 3]]))
    found = workbooks.workbook_files(spark, str(tmp_path))
    assert sorted((r.name or "", r.n or "") for r in workbooks.read_excel(found).collect()) == [("", "3"), ("a", "1"), ("b", "")]
    assert sorted((r.who or "", r.n or 0) for r in workbooks.read_excel(found, 1, "who string, n int").collect()) == [("", 3), ("a", 1), ("b", 0)]
    with pytest.raises(Exception, match="no sheet 'other'"):
        workbooks.read_excel(found, "other")
    write(tmp_path, "three.xlsx", workbook([["name", "m"], ["x", 3]]))
    with pytest.raises(ValueError, match="different columns.*three.xlsx"):
        workbooks.read_excel(workbooks.workbook_files(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="valid"):
        workbooks.check_archive(b"nonsense")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("x", b"0" * 10_000_000)
    with pytest.raises(ValueError, match="unsafe"):
        workbooks.check_archive(bomb.getvalue())
    write(tmp_path, "four.xlsx", bomb.getvalue())
    with pytest.raises(Exception, match="unsafe"):
        workbooks.read_excel(workbooks.workbook_files(spark, str(tmp_path)))


def test_sheets_shared_texts_and_reading_aids():
    buffer, main = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>aid</t></rPh></si></sst>")
        archive.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                         '<sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                         '<Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for i in (1, 2):
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {main}><sheetData><row><c r="AB1" t="s"><v>{i - 1}</v></c></row><row/></sheetData></worksheet>')
    archive = workbooks.check_archive(buffer.getvalue())
    assert workbooks.sheet_parts(archive) == [("B", "xl/worksheets/sheet2.xml"), ("A", "xl/worksheets/sheet1.xml")]
    shared = workbooks._shared_texts(archive)
    assert shared == ["plain", "rich"]
    assert list(workbooks.sheet_rows(archive, "xl/worksheets/sheet2.xml", shared)) == [[None] * 27 + ["rich"], []]


def test_workbooks_give_back_what_was_written(spark):
    rows = [(1, 0.1, True, "a<&>\"'", "2024-05-01 10:00:00"), (None, None, None, None, None), (-(2**62), 1e-300, False, " _x0041_ \r\n\t\x01 é😀 ", None), (3, 2.0, None, "", None)]
    df = spark.createDataFrame(rows * 40, "id long, x double, flag boolean, text string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    books = workbooks.as_workbooks(df.repartition(3), max_bytes=2000)
    found = books.collect()
    assert len(found) > 6 and len({r.path for r in found}) == len(found)
    read = workbooks.read_excel(books, schema=df.schema)
    assert read.dtypes == df.dtypes
    assert read.exceptAll(df).count() == 0 and df.exceptAll(read).count() == 0
    even = workbooks.as_workbooks(spark.range(30000).select(F.lit("a" * 50).alias("t")).coalesce(1))
    assert workbooks.read_excel(even).count() == 30000
    empty = workbooks.as_workbooks(df.limit(0))
    assert workbooks.read_excel(empty, schema=df.schema).collect() == []
    with pytest.raises(ValueError, match="no workbook"):
        workbooks.read_excel(empty)


@pytest.mark.parametrize("statement, allowed", [
    ("SELECT 1", True), ("with x as (select 1) select * from x;", True), ("-- note\n(SELECT 1)", True), ("", False), ("-- only", False),
    ("SELECT 1; SELECT 2", False), ("DROP TABLE x", False), ("SELECT * FROM x WHERE /* */ 1 = 1 ; delete from x", False), ("WITH a AS (SELECT 1) MERGE INTO b", False),
    ("SELECT updated_at FROM x", True), ("selection", False),
])
def test_read_only_sql(statement, allowed):
    if allowed:
        assert sql.check_read_only(statement)
    else:
        with pytest.raises(ValueError):
            sql.check_read_only(statement)


def test_jdbc_options():
    options = sql.jdbc_options("jdbc:x", "SELECT 1", user="u", password="p")
    assert options["query"] == "SELECT 1" and options["fetchsize"] == "10000"
    with pytest.raises(ValueError):
        sql.jdbc_options("jdbc:x", "DELETE FROM t", user="u", password="p")


def test_catalog(spark):
    tables = {
        "customers": spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"),
        "orders": spark.createDataFrame([(1, 1, "Delivered"), (2, 9, "open"), (3, None, "open")], "id long, customer_id long, status string"),
    }
    assert [tuple(r) for r in catalog.fk_infer(tables).collect()] == [("orders", "customer_id", "customers", "id", 1)]
    assert catalog.fk_infer(tables, declared={("orders", "customer_id", "customers")}).count() == 0
    profile = {(r.table, r.column): r for r in catalog.catalog_profile(tables).collect()}
    assert profile[("orders", "status")].sample_values == "Delivered|open" and profile[("orders", "id")].unique_key
    assert not profile[("orders", "customer_id")].unique_key
    assert catalog.status_count(tables, "quanti orders consegnati?").first().total == 1
    assert catalog.status_count(tables, "customers").count() == 2
    assert catalog.status_count(tables, "weather") is None


def test_references_by_value(spark):
    people = spark.range(5000).select((F.col("id") * 7).alias("number"), F.lit("x").alias("note"), F.md5(F.col("id").cast("string")).alias("mail"))
    visits = spark.range(20_000).select(
        F.when(F.col("id") % 50 != 0, F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4800 * 7)).alias("who"), F.col("id").cast("double").alias("d"),
        F.md5((F.col("id") % 6000).cast("string")).alias("contact"), (F.col("id") % 10).cast("int").alias("few"), F.col("id").cast("string").alias("a.b"))
    few = spark.createDataFrame([(i,) for i in range(9)] + [(None,)], "code int")
    tables = {"people": people, "visits": visits, "few": few}
    found = {tuple(r)[:4]: tuple(r)[4:] for r in catalog.fk_by_value(tables, least=0.8).collect()}
    # 5,000 of 6,000 contacts are known; a key with a null or with repeats is none.
    assert found == {("visits", "who", "people", "number"): (19_600, 0), ("visits", "contact", "people", "mail"): (20_000, 3000)}
    assert catalog.fk_candidates(tables, 0.9) == [("visits", "who", "people", "number")]
    assert catalog.fk_by_value({"e": few.limit(0), "f": people.limit(0)}).count() == 0
    plan = catalog.fk_by_value(tables, least=0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def run_stream(spark, tmp_path, rows, schema, build, mode):
    source, name = str(tmp_path / "in"), f"out_{mode}_{os.path.basename(tmp_path).replace('-', '_')}"
    frame = spark.createDataFrame(rows, schema)
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_rate_and_sla_streams(spark, tmp_path):
    rows = [(f"2026-01-01 00:00:{s:02d}", 1, float(s)) for s in range(10)] + [("2026-01-01 00:00:30", 2, 5.0)] + [("2026-01-01 01:00:00", 1, 1.0)]
    found = run_stream(spark, tmp_path, rows, "ts string, user_id int, value double", lambda s: monitors.rate_breaches(s, "ts", ["user_id"], 5), "complete")
    assert [(r.user_id, r.requests) for r in found.collect()] == [(1, 10)]
    second = tmp_path / "sla"
    second.mkdir()
    found = run_stream(spark, second, rows, "ts string, user_id int, value double", lambda s: monitors.sla_monitor(s, "ts", "value", 5), "complete")
    assert sorted((r.valid_count, r.breach_count) for r in found.collect()) == [(1, 0), (11, 4)]


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = [("2026-01-01", "p", "usage", None), ("2026-01-01", "p", "feedback", "positive"), ("2026-01-01", "q", "feedback", "negative")] * 2
    schema = "ts string, pattern_id string, event_type string, feedback string"
    found = run_stream(spark, tmp_path, rows, schema, monitors.feedback_fold, "complete")
    batch = monitors.feedback_fold(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
