"""Spreadsheets (Office Open XML workbooks) as a data source.

    spark.read.format("sheets").schema(...).option("sheets", "2010\\n2011").load(path)

A workbook is a zip of XML files. Each sheet is a partition: its XML is parsed as a
stream, row by row, so a task holds the workbook's shared strings and some thousand
rows. Columns are found by the names in a sheet's first row; the rows of several
sheets, or several workbooks (`path` separated by newlines), are one table.

Cells: shared, inline and formula strings, numbers, booleans, ISO dates, and numbers
under a date format, in both date systems. An empty cell, an error, and a cell that a
row leaves out are null; a row without any value is left out. Whole numbers read as
strings have no decimal point. A value that the schema's type can't hold raises a
ValueError that names sheet and cell, as does a column that a sheet lacks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from origo.functions import ship

# Namespaces and parts of the format, and its numbers of date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
BATCH = 4096


def opened(path: str):
    """A file that can be sought in, of whatever store names the path."""
    if re.match(r"^[a-z][a-z0-9+.-]+://", path):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file:"), "rb")


class Workbook:
    """The parts of a workbook that its sheets share."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file if hasattr(file, "seekable") else io.BytesIO(file.read()))
        book = ElementTree.parse(self.zip.open("xl/workbook.xml")).getroot()
        links = ElementTree.parse(self.zip.open("xl/_rels/workbook.xml.rels")).getroot()
        target = {x.get("Id"): x.get("Target") for x in links.iter(f"{PACKAGE}Relationship")}
        self.sheets = {x.get("name"): self._part(target[x.get(RELATION)]) for x in book.iter(f"{MAIN}sheet")}
        options = book.find(f"{MAIN}workbookPr")
        self.late = options is not None and options.get("date1904") in ("1", "true")

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _whole(self, name: str):
        return ElementTree.parse(self.zip.open(name)).getroot() if name in self.zip.namelist() else None

    def strings(self) -> list[str]:
        root = self._whole("xl/sharedStrings.xml")
        return [] if root is None else [_text(x) for x in root.iter(f"{MAIN}si")]

    def dated(self) -> list[bool]:
        """Of each cell style, whether it shows a date."""
        root = self._whole("xl/styles.xml")
        if root is None:
            return []
        own = {int(x.get("numFmtId")): _shows_date(x.get("formatCode")) for x in root.iter(f"{MAIN}numFmt")}
        styles = root.find(f"{MAIN}cellXfs")
        numbers = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
        return [own.get(n, n in DATE_FORMATS) for n in numbers]

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, object]]]:
        """Number and cells (by column from 0) of each row with a value."""
        strings, dated, number = self.strings(), self.dated(), 0
        with self.zip.open(self.sheets[sheet]) as part:
            events = ElementTree.iterparse(part, events=("start", "end"))
            _, root = next(events)
            for kind, node in events:
                if kind == "end" and node.tag == f"{MAIN}row":
                    number = int(node.get("r", number + 1))
                    cells, column = {}, -1
                    for cell in node.iter(f"{MAIN}c"):
                        column = _column(cell.get("r")) if cell.get("r") else column + 1
                        value = self._value(cell, strings, dated)
                        if value is not None:
                            cells[column] = value
                    if cells:
                        yield number, cells
                    root.clear()

    def _value(self, cell, strings: list[str], dated: list[bool]):
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _text(cell.find(f"{MAIN}is"))
        found = cell.find(f"{MAIN}v")
        raw = None if found is None else found.text
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(raw)]
        if kind == "str":
            return raw
        if kind == "b":
            return raw == "1"
        if kind == "d":
            return datetime.fromisoformat(raw)
        style = int(cell.get("s", 0))
        return self.instant(float(raw)) if style < len(dated) and dated[style] else float(raw)

    def instant(self, days: float) -> datetime:
        """Days since the system's first one; in the early system, days from March
        1900 on count a leap day that never was."""
        if self.late:
            first = datetime(1904, 1, 1)
        else:
            first = datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
        return first + timedelta(milliseconds=round(days * 86_400_000))


def _text(node) -> str:
    """The text of a string: all its pieces, without hints for pronouncing."""
    return "" if node is None else "".join(t.text or "" for part in node for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t") if part.tag == f"{MAIN}r" else []))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _shows_date(code: str) -> bool:
    """Whether a format has a letter of dates outside of quotes, escapes and brackets."""
    return re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code.split(";")[0]), re.IGNORECASE) is not None


def converted(value, kind: T.DataType, book: Workbook | None = None):
    """A cell's value as a type of the schema holds it."""
    if value is None or (value == "" and not isinstance(kind, T.StringType)):
        return None
    if isinstance(kind, T.StringType):
        if isinstance(value, bool):
            return str(value).lower()
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    if isinstance(kind, T.BooleanType) and isinstance(value, bool | float):
        return bool(value)
    if isinstance(kind, T.TimestampNTZType | T.TimestampType | T.DateType):
        when = book.instant(value) if isinstance(value, float) and book else value
        when = datetime.fromisoformat(when) if isinstance(when, str) else when
        if isinstance(when, date):
            return when.date() if isinstance(kind, T.DateType) else when
    if isinstance(value, bool | float | str):
        if isinstance(kind, T.IntegralType):
            whole = int(value) if isinstance(value, bool | str) else value
            if whole == int(whole):
                return int(whole)
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return float(value)
        elif isinstance(kind, T.DecimalType):
            return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[_Sheet]:
        wanted = [s for s in self.options.get("sheets", "").split("\n") if s]
        found = []
        for path in self.options["path"].split("\n"):
            with opened(path) as file:
                names = list(Workbook(file).sheets)
            lost = set(wanted) - set(names)
            if lost:
                raise ValueError(f"{path} has no sheet {', '.join(sorted(lost))}")
            found += [_Sheet(path, s) for s in wanted or names]
        return found

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        arrow, fields = to_arrow_schema(self.schema), self.schema.fields
        with opened(partition.path) as file:
            book, at, held = Workbook(file), None, []
            for number, cells in book.rows(partition.sheet):
                if at is None:
                    names = {str(v): c for c, v in cells.items()}
                    lost = [f.name for f in fields if f.name not in names]
                    if lost:
                        raise ValueError(f"sheet {partition.sheet} has no column {', '.join(lost)}")
                    at = [names[f.name] for f in fields]
                    continue
                try:
                    held.append([converted(cells.get(c), f.dataType, book) for c, f in zip(at, fields)])
                except (ValueError, InvalidOperation, OverflowError) as e:
                    raise ValueError(f"sheet {partition.sheet}, row {number}: {e}") from e
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)


class SheetSource(DataSource):
    """The format `sheets`; a schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> T.StructType:
        raise ValueError("a schema must be given")

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(schema, dict(self.options))


def read_workbook(spark: SparkSession, path: str, schema: str, sheets: list[str] | None = None) -> DataFrame:
    """The rows of the named sheets, or of all, of a workbook as one table."""
    ship(spark)
    spark.dataSource.register(SheetSource)
    return spark.read.format("sheets").schema(schema).option("sheets", "\n".join(sheets or [])).load(path)
