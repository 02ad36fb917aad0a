"""Point layers (.shp, .shx, .dbf, .prj, .cpg) as a Spark data source, read and written in parts.

A layer is a folder of parts, each a whole layer file set of at most ROWS_PER_PART points.
Tasks stage parts, which are moved in when the job commits.
"""

from __future__ import annotations

import datetime
import math
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from placemetrics.functions.semantics import as_column
from placemetrics.sources.staged import Part, StagedWriter, opened, parts_of, register_source

__all__ = ["write_points", "read_points", "short_names"]

ROWS_PER_PART = 100_000
#: Fixed values of the formats: file code, version, shapes, longest text, longest name.
SHAPE_CODE, SHAPE_VERSION, NO_SHAPE, POINT = 9994, 1000, 0, 1
LONGEST_TEXT, LONGEST_NAME = 254, 10
WGS84 = ('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],'
         'PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]')


def write_points(df: DataFrame, path: str, properties: Sequence[str], lon: Column | str = "lon",
                 lat: Column | str = "lat", mode: str = "overwrite") -> None:
    """A point layer with the columns ``properties``.

    Names are cut to 10 bytes, clashes numbered (``short_names``).  Rows without both finite coordinates
    keep their properties and have no shape.  The format has no empty text and no number that is
    not finite: they are missing when read, as are blanks at the end of a text.  A text of
    over 254 bytes is an error, as are columns other than text, whole numbers, floating numbers, booleans and dates.
    """
    register_source(df.sparkSession, PointLayer)
    points = df.select(as_column(lon).cast("double").alias("lon"), as_column(lat).cast("double").alias("lat"), *properties)
    points.write.format("point_layer").mode(mode).save(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``lon`` and ``lat`` and the properties of a layer, one task a part."""
    register_source(spark, PointLayer)
    return spark.read.format("point_layer").load(path)


def short_names(names: Sequence[str]) -> list[str]:
    """Names of at most 10 bytes, different whatever their case: a later clash ends in ``_1``, ``_2``, ..."""
    out: list[str] = []
    for name in names:
        short, number = _cut(name, LONGEST_NAME), 0
        while short.lower() in (o.lower() for o in out):
            number += 1
            ending = f"_{number}"
            short = _cut(name, LONGEST_NAME - len(ending)) + ending
        out.append(short)
    return out


def _cut(name: str, size: int) -> str:
    return name.encode()[:size].decode(errors="ignore")


class PointLayer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "point_layer"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        fields = [T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]
        with opened(path)[0].open_input_stream(_table_of(parts_of(path, "shp")[0])) as table:
            return T.StructType(fields + [T.StructField(f.name, _KINDS[f.kind]()) for f in _table_fields(table)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PointReader(self.options["path"], schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return PointWriter(self.options["path"], schema, overwrite)


@dataclass
class Field:
    name: str
    kind: str
    width: int


#: Kinds of columns: text, whole number, floating number, boolean, date.
_KINDS = {"C": T.StringType, "N": T.LongType, "F": T.DoubleType, "L": T.BooleanType, "D": T.DateType}
_KIND_OF = {"string": "C", "tinyint": "N", "smallint": "N", "int": "N", "bigint": "N",
            "float": "F", "double": "F", "boolean": "L", "date": "D"}
_WIDTHS = {"N": 20, "F": 24, "L": 1, "D": 8}


class PointWriter(StagedWriter):
    rows_per_part, suffixes = ROWS_PER_PART, ("shp", "shx", "dbf", "prj", "cpg")

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        fields = schema.fields[2:]
        others = [f.name for f in fields if f.dataType.simpleString() not in _KIND_OF]
        if others or not fields:
            raise ValueError(f"a point layer can't hold {others}" if others else "a point layer needs a property")
        self.names = short_names([f.name for f in fields])
        if {"lon", "lat"} & {n.lower() for n in self.names}:
            raise ValueError("lon and lat are the names of the coordinates")
        self.kinds = [_KIND_OF[f.dataType.simpleString()] for f in fields]
        super().__init__(path, overwrite)

    def contents(self, rows: Sequence[tuple]) -> Sequence[bytes]:
        shapes, index = _shape_files([row[:2] for row in rows])
        return shapes, index, _table_file(self.names, self.kinds, [row[2:] for row in rows]), WGS84.encode(), b"UTF-8"


def _shape_files(points: Sequence[tuple]) -> tuple[bytes, bytes]:
    """Points and their index; lengths and offsets count words of two bytes."""
    body, index, seen = bytearray(), bytearray(), []
    for number, (x, y) in enumerate(points, 1):
        if all(v is not None and math.isfinite(v) for v in (x, y)):
            seen.append((x, y))
            content = struct.pack("<idd", POINT, x, y)
        else:
            content = struct.pack("<i", NO_SHAPE)
        index += struct.pack(">ii", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">ii", number, len(content) // 2) + content
    xs, ys = zip(*seen) if seen else ((0.0,), (0.0,))
    box = struct.pack("<8d", min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)

    def head(size: int) -> bytes:
        return struct.pack(">7i", SHAPE_CODE, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<ii", SHAPE_VERSION, POINT) + box

    return head(len(body)) + bytes(body), head(len(index)) + bytes(index)


def _table_file(names: Sequence[str], kinds: Sequence[str], rows: Sequence[tuple]) -> bytes:
    texts = [[_as_bytes(value, kind) for value, kind in zip(row, kinds)] for row in rows]
    widths = [_WIDTHS.get(kind) or max([1, *(len(row[k]) for row in texts)]) for k, kind in enumerate(kinds)]
    today = datetime.date.today()
    head = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), 33 + 32 * len(names), 1 + sum(widths))
    for name, kind, width in zip(names, kinds, widths):
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, 15 if kind == "F" else 0)
    lines = (b" " + b"".join(v.rjust(w) if k in "NF" else v.ljust(w) for v, w, k in zip(row, widths, kinds)) for row in texts)
    return head + b"\r" + b"".join(lines) + b"\x1a"


def _as_bytes(value: object, kind: str) -> bytes:
    if value is None or kind == "F" and not math.isfinite(value):
        return b"?" if kind == "L" else b""
    if kind == "L":
        return b"T" if value else b"F"
    if kind == "D":
        return value.strftime("%Y%m%d").rjust(8, "0").encode()
    data = repr(value).encode() if kind == "F" else str(value).encode()
    if kind == "C" and len(data) > LONGEST_TEXT:
        raise ValueError(f"a point layer holds texts of {LONGEST_TEXT} bytes at most, this one has {len(data)}")
    return data


def _as_value(data: bytes, kind: str) -> object:
    text = data.decode().rstrip(" \0") if kind == "C" else data.decode().strip(" \0")
    if not text or kind == "L" and text == "?":
        return None
    if kind == "C":
        return text
    if kind == "L":
        return text in "TtYy"
    if kind == "D":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:]))
    return int(text) if kind == "N" else float(text)


def _table_of(shapes: str) -> str:
    return shapes.removesuffix(".shp") + ".dbf"


def _table_fields(table) -> list[Field]:
    """Fields from the head of a table file; whole numbers are those without decimals."""
    size = struct.unpack("<H", table.read(32)[8:10])[0]
    fields = []
    described = table.read(size - 32)
    for at in range(0, len(described) - 32, 32):
        if described[at] == 13:
            break
        name, kind, width, decimals = struct.unpack("<11sc4xBB14x", described[at : at + 32])
        kind = kind.decode()
        if kind not in _KINDS:
            raise ValueError(f"columns of kind {kind} can't be read")
        fields.append(Field(name.split(b"\0")[0].decode(), "F" if kind == "N" and decimals else kind, width))
    return fields


class PointReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str]) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[InputPartition]:
        return [Part(path) for path in parts_of(self.path, "shp")]

    def read(self, partition: Part) -> Iterator[tuple]:
        files, _ = opened(self.path)
        with (files.open_input_stream(_table_of(partition.path), buffer_size=1 << 20) as table,
              files.open_input_stream(partition.path, buffer_size=1 << 20) as shapes):
            fields = _table_fields(table)
            shapes.read(100)
            length = 1 + sum(f.width for f in fields)
            while head := shapes.read(8):
                content = shapes.read(2 * struct.unpack(">ii", head)[1])
                record = table.read(length)
                kind = struct.unpack("<i", content[:4])[0]
                if kind not in (NO_SHAPE, POINT):
                    raise ValueError(f"shape {kind} is no point")
                x, y = struct.unpack("<dd", content[4:20]) if kind == POINT else (None, None)
                values, at = {"lon": x, "lat": y}, 1
                for f in fields:
                    values[f.name] = _as_value(record[at : at + f.width], f.kind)
                    at += f.width
                if record[:1] != b"*":  # marked as deleted
                    yield tuple(values[name] for name in self.wanted)
