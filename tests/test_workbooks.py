"""Sheets of workbooks, written here by hand and by the library."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from placemetrics.sources import read_workbook, workbooks, write_workbooks

MAIN, RELATIONS = workbooks.MAIN, workbooks.RELATIONS


def by_hand(path, sheets, texts=(), formats="", styles="", workbook=""):
    """A workbook of sheets given as XML rows."""
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}">{workbook}<sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k == 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}/relationships">{targets}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if texts:
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(f"<si>{t}</si>" for t in texts)}</sst>')
        if styles:
            book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts>{formats}</numFmts><cellXfs>{styles}</cellXfs></styleSheet>')


TEXTS = ["<t>Role</t>", "<r><t>Tor</t></r><r><t>onto</t></r><rPh><t>x</t></rPh>", "<t> web </t>", "<t>   </t>"]
ROLES = ('<row r="1"><c r="A1" t="inlineStr"><is><t>a title</t></is></c></row>'
         '<row r="4"><c r="A4" t="s"><v>0</v></c><c r="C4" t="s"><v>1</v></c><c r="D4" t="s"><v>1</v></c></row>'
         '<row r="5"><c r="A5" t="s"><v>2</v></c><c r="B5"><v>2015</v></c><c r="C5"><v>1.5e3</v></c><c r="E5" t="b"><v>1</v></c></row>'
         '<row r="8"><c r="A8" t="s"><v>3</v></c><c r="B8" t="str"><f>1</f><v>none</v></c><c r="C8" t="e"><v>#N/A</v></c></row>'
         '<row r="9"><c r="A9" t="s"><v>3</v></c></row>')


def test_sheet_skip_names_and_types(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    by_hand(path, {"Other": "", "Canada Data": ROLES}, TEXTS)
    df = read_workbook(spark, path, "Canada Data", skip=1)
    assert df.dtypes == [("Role", "string"), ("column_2", "string"), ("Toronto", "double"), ("Toronto_4", "string"), ("column_5", "boolean")]
    none = (None,) * 5
    assert list(map(tuple, df.collect())) == [("web", "2015", 1500.0, None, True), none, none, (None, "none", None, None, None)]
    typed = read_workbook(spark, path, "Canada Data", 1, "role string, year int")
    assert list(map(tuple, typed.collect())) == [("web", 2015), (None, None), (None, None), (None, None)]
    assert read_workbook(spark, path, schema="a string").collect() == []
    with pytest.raises(Exception, match="no sheet"):
        read_workbook(spark, path, "canada").collect()


@pytest.mark.parametrize("workbook, first", [("", datetime.datetime(1900, 1, 1)), ('<workbookPr date1904="1"/>', datetime.datetime(1904, 1, 2))])
def test_days_and_times(spark, tmp_path, workbook, first):
    path = str(tmp_path / "d.xlsx")
    rows = ('<row><c t="str"><v>when</v></c><c t="str"><v>how much</v></c></row><row><c s="1"><v>1</v></c><c s="2"><v>7</v></c></row>'
            '<row><c s="1"><v>42844.75</v></c></row>')
    by_hand(path, {"s": rows}, formats='<numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="[Red]0 &quot;days&quot;"/>',
            styles='<xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/>', workbook=workbook)
    df = read_workbook(spark, path)
    assert df.dtypes == [("when", "timestamp_ntz"), ("how much", "double")]
    later = first + datetime.timedelta(42843 - (first.year == 1900), 64800)
    assert list(map(tuple, df.collect())) == [(first, 7.0), (later, None)]


def test_written_workbooks_come_back(spark, tmp_path):
    path = str(tmp_path / "books")
    rows = [(1, "a <b> & \"c\"\nd\r", 0.1 + 0.2, True, datetime.date(2017, 4, 19), datetime.datetime(2017, 4, 19, 6)),
            (2, None, None, None, datetime.date(1900, 1, 31), None), (2**53, "é", -1e300, False, None, None)]
    schema = "n bigint, s string, x double, b boolean, d date, t timestamp_ntz"
    df = spark.createDataFrame(rows, schema).repartition(2, "n")
    write_workbooks(df, path, "Données & more", ["a title", "another"])
    back = read_workbook(spark, path, "Données & more", 2, schema)
    want = [(n, s.strip() if s else s, x, b, d, t) for n, s, x, b, d, t in rows]
    assert sorted(map(tuple, back.collect())) == sorted(want)
    write_workbooks(df.filter("false"), path)
    assert read_workbook(spark, path).columns == df.columns and read_workbook(spark, path).collect() == []


def test_large_sheets_and_many_books(spark, tmp_path):
    path = str(tmp_path / "many")
    write_workbooks(spark.range(0, 30000, 1, 3).withColumn("s", F.col("id").cast("string")), path)
    df = read_workbook(spark, path, schema="id bigint, s string")
    assert df.rdd.getNumPartitions() == 3
    assert df.filter("s = id").agg(F.count_distinct("id"), F.sum("id")).first() == (30000, 29999 * 15000)


@pytest.mark.parametrize("value", ["repeat('x', 32768)", "char(7)", "9007199254740993L", "DATE'1899-12-31'"])
def test_what_a_cell_cannot_hold(spark, tmp_path, value):
    with pytest.raises(Exception, match="can't hold|no days"):
        write_workbooks(spark.range(1).selectExpr(f"{value} AS v"), str(tmp_path / "no"))
