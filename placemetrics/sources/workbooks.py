"""Sheets of workbooks (.xlsx) as a Spark data source: one task a workbook, read as a stream."""

from __future__ import annotations

import datetime
import io
import itertools
import math
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from placemetrics.sources.staged import Part, StagedWriter, opened, parts_of, register_source

__all__ = ["read_workbook", "write_workbooks"]

#: Rows of a written sheet (the format holds ten times as many), and letters of a text that the format holds at most.
ROWS_PER_SHEET, LETTERS_PER_CELL = 100_000, 32767
#: Fixed values of the format: number formats that mean a day or a time.
DAY_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, skip: int = 0,
                  schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of one sheet (the first unless named) of a workbook, or of all workbooks of a folder.

    The first ``skip`` rows and empty rows after them are left out; the next row is the header.
    Columns go by position.  With a schema the header is not looked at; without one names and types
    come from the first workbook, which is read once for that: a column of numbers is double, of days
    and times timestamp_ntz, of TRUE and FALSE boolean, every other one text; header cells without text
    give ``column_<n>``, repeated names end in ``_<n>``.  Texts are trimmed, blank ones and error cells are missing,
    as is what does not fit a type.  Empty rows between others are rows without values.
    """
    register_source(spark, Workbooks)
    reader = spark.read.format("workbook").option("skip", skip)
    if sheet is not None:
        reader = reader.option("sheet", sheet)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1", titles: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A folder of workbooks, one or more a task, each with a sheet of ``titles``, a header and rows.

    Texts, numbers, booleans, days and times without a zone; a text over 32,767 letters or with signs that XML
    has not is an error.  Numbers are doubles, as the format has no others: whole numbers beyond 2^53 are an error too.
    """
    register_source(df.sparkSession, Workbooks)
    df.write.format("workbook").option("sheet", sheet).option("titles", "\n".join(titles)).mode(mode).save(path)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        path = parts_of(self.options["path"], "xlsx")[0]
        rows = _sheet_rows(self.options["path"], path, self.options.get("sheet"), int(self.options.get("skip", 0)))
        names, kinds = _names(next(rows, [])), []
        for row in rows:
            kinds.extend(set() for _ in range(len(row) - len(kinds)))
            for k, value in enumerate(row):
                if value is not None:
                    kinds[k].add(type(value))
        # values beyond the header's last cell have columns too
        names = _names(names + [None] * (len(kinds) - len(names)))
        types = {frozenset([float]): T.DoubleType(), frozenset([bool]): T.BooleanType(),
                 frozenset([datetime.datetime]): T.TimestampNTZType()}
        return T.StructType([T.StructField(name, types.get(frozenset(seen), T.StringType()))
                             for name, seen in itertools.zip_longest(names, kinds, fillvalue=())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options, schema, overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.sheet, self.skip = options["path"], options.get("sheet"), int(options.get("skip", 0))
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        others = [k for k in self.kinds if k not in _READ_AS]
        if others:
            raise ValueError(f"cells can't be read as {others}")

    def partitions(self) -> list[InputPartition]:
        return [Part(path) for path in parts_of(self.path, "xlsx")]

    def read(self, partition: Part) -> Iterator[tuple]:
        rows = _sheet_rows(self.path, partition.path, self.sheet, self.skip)
        next(rows, None)
        for row in rows:
            yield tuple(None if value is None else _READ_AS[kind](value)
                        for value, kind in itertools.zip_longest(row[: len(self.kinds)], self.kinds))


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


def _number(value: object) -> float | None:
    if isinstance(value, datetime.datetime):
        return None
    try:
        number = float(value)
    except ValueError:
        return None
    return number if math.isfinite(number) else None


def _whole(bits: int):
    def whole(value: object) -> int | None:
        number = _number(value)
        return int(number) if number is not None and number.is_integer() and -(2.0**bits) <= number < 2.0**bits else None
    return whole


def _truth(value: object) -> bool | None:
    if isinstance(value, str):
        return {"true": True, "false": False}.get(value.lower())
    return value != 0 if isinstance(value, (bool, float)) else None


def _moment(value: object) -> datetime.datetime | None:
    if isinstance(value, str):
        try:
            return datetime.datetime.fromisoformat(value).replace(tzinfo=None)
        except ValueError:
            return None
    return value if isinstance(value, datetime.datetime) else None


def _day(value: object) -> datetime.date | None:
    moment = _moment(value)
    return moment and moment.date()


_READ_AS = {"string": _text, "double": _number, "int": _whole(31), "bigint": _whole(63), "boolean": _truth,
            "timestamp_ntz": _moment, "date": _day}


def _names(header: Sequence[object]) -> list[str]:
    """Names of a header's cells, different whatever their case."""
    out: list[str] = []
    for k, cell in enumerate(header, 1):
        name = f"column_{k}" if cell is None else _text(cell)
        while name.lower() in (o.lower() for o in out):
            name = f"{name}_{k}"
        out.append(name)
    return out


def _sheet_rows(asked: str, path: str, sheet: str | None, skip: int) -> Iterator[list]:
    """Header and rows of a sheet; the whole sheet is never held, its workbook's list of texts is."""
    files = opened(asked)[0]
    with files.open_input_file(path) as file, zipfile.ZipFile(file) as book:
        member, from_1904 = _member(book, sheet, path)
        texts, days = _shared_texts(book), _day_styles(book)
        start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
        number, blank, begun = 0, 0, False
        for element in _elements(book, member, "sheetData", "row"):
            before, number = number, int(element.get("r", number + 1))
            if number <= skip:
                continue
            row = _cells(element, texts, days, start)
            blank += number - max(before, skip) - 1
            if not any(value is not None for value in row):
                blank += 1
                continue
            if begun:
                yield from ([] for _ in range(blank))
            begun, blank = True, 0
            yield row


def _elements(book: zipfile.ZipFile, member: str, parent: str, child: str) -> Iterator[ElementTree.Element]:
    """The children of an element one by one, each given up after use."""
    with book.open(member) as stream:
        inside = None
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            tag = element.tag.rpartition("}")[2]
            if event == "start" and tag == parent:
                inside = element
            elif event == "end" and tag == child and inside is not None:
                yield element
                inside.clear()


def _named(element: ElementTree.Element, tag: str) -> Iterator[ElementTree.Element]:
    return element.iter(f"{{{MAIN}}}{tag}")


def _member(book: zipfile.ZipFile, sheet: str | None, path: str) -> tuple[str, bool]:
    """Where in the file a sheet is, and whether its days count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = {s.get("name"): s.get(f"{{{RELATIONS}}}id") for s in _named(root, "sheet")}
    wanted = next(iter(sheets)) if sheet is None else sheet
    if wanted not in sheets:
        raise ValueError(f"{path} has no sheet {wanted!r} but {list(sheets)}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    marks = [p.get("date1904") for p in _named(root, "workbookPr")]
    return posixpath.join("/xl", targets[sheets[wanted]])[1:], any(m in ("1", "true") for m in marks)


def _said(element: ElementTree.Element) -> str:
    """The text of an entry, of all its runs; readings put beside it are not part of it."""
    inside = [t for part in element if part.tag != f"{{{MAIN}}}rPh" for t in _named(part, "t")]
    return "".join(t.text or "" for t in inside)


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_said(entry) for entry in _elements(book, "xl/sharedStrings.xml", "sst", "si")]


def _day_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a day or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in _named(root, "numFmt")
           if re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    styles = (xf for group in _named(root, "cellXfs") for xf in group)
    return {k for k, xf in enumerate(styles) if int(xf.get("numFmtId", 0)) in DAY_FORMATS | own}


def _column(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cells(row: ElementTree.Element, texts: list[str], days: set[int], start: datetime.datetime) -> list:
    out: list = []
    for cell in _named(row, "c"):
        place = _column(cell.get("r")) if cell.get("r") else len(out)
        out.extend([None] * (place + 1 - len(out)))
        kind, found = cell.get("t", "n"), next(_named(cell, "v"), None)
        if kind == "inlineStr":
            out[place] = next((_said(entry) for entry in _named(cell, "is")), "").strip() or None
        elif found is not None and found.text and kind != "e":
            value = found.text
            if kind in ("s", "str"):
                out[place] = (texts[int(value)] if kind == "s" else value).strip() or None
            elif kind == "b":
                out[place] = value == "1"
            elif kind == "d":
                out[place] = _moment(value)
            elif int(cell.get("s", 0)) in days:
                out[place] = _from_days(float(value), start)
            else:
                out[place] = float(value)
    return out


def _from_days(days: float, start: datetime.datetime) -> datetime.datetime:
    # the format counts a 29 February 1900
    early = start.year == 1899 and days < 60
    return start + datetime.timedelta(days=early) + datetime.timedelta(milliseconds=round(days * 86_400_000))


_FIXED = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(
        f'<Override PartName="/xl/{name}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>'
        for name, kind in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"))) + "</Types>",
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" '
    'Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" '
    f'Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{RELATIONS}/styles" '
    'Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0"/></cellStyleXfs>'
    '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


class WorkbookWriter(StagedWriter):
    rows_per_part, suffixes = ROWS_PER_SHEET, ("xlsx",)

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.sheet, self.titles = options.get("sheet", "Sheet1"), [t for t in options.get("titles", "").split("\n") if t]
        self.header = tuple(schema.fieldNames())

    def contents(self, rows: Sequence[tuple]) -> Sequence[bytes]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in _FIXED.items():
                book.writestr(name, text)
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name={quoteattr(self.sheet)} '
                          'sheetId="1" r:id="r1"/></sheets></workbook>')
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for row in itertools.chain(((title,) for title in self.titles), [self.header], rows):
                    sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                sheet.write(b"</sheetData></worksheet>")
        return [out.getvalue()]


def _cell(value: object) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime.date):
        moment = value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
        days = (moment - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
        if days < 2:
            raise ValueError(f"the format has no days before 1900, this is {value}")
        return f'<c s="1"><v>{days - (days < 61)!r}</v></c>'
    if isinstance(value, str):
        if len(value) > LETTERS_PER_CELL or re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", value):
            raise ValueError(f"a cell can't hold this text of {len(value)} letters")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value, {chr(13): "&#13;"})}</t></is></c>'
    if isinstance(value, int) and abs(value) > 1 << 53:
        raise ValueError(f"a cell can't hold {value} exactly")
    return f"<c><v>{value!r}</v></c>" if isinstance(value, (int, float)) else f"<c><v>{value}</v></c>"
