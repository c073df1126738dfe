"""Spreadsheets as a Spark data source: `spark.read.format("xlsx").schema(...).load(path)`.

A workbook is a zip archive of XML; the standard library reads it. Cells come as text, numbers, booleans or dates by
the schema's types; unreadable dates and numbers are NULL. Each file of a folder is one partition, read by an executor.
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from strata.session import ship

#: Fixed values of the file format: namespaces, and day 0 of serial dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
EPOCH = dt.datetime(1899, 12, 30)


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list]:
    """Rows of the first sheet; cells are str, float, bool or None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with book.open(first) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                out: list = []
                for i, cell in enumerate(row.iter(f"{MAIN}c")):
                    at = column_number(cell.get("r")) if cell.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        out[at] = shared[int(value.text)]
                    elif kind == "b":
                        out[at] = value.text == "1"
                    elif kind in ("str", "e", "d"):
                        out[at] = value.text
                    else:
                        out[at] = float(value.text)
                row.clear()
                yield out


def convert(value, kind: DataType):
    """A cell as a value of a Spark type, NULL where it can't be."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    try:
        if isinstance(kind, StringType):
            return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
        if isinstance(kind, (DateType, TimestampType)):
            stamp = EPOCH + dt.timedelta(days=value) if isinstance(value, float) else dt.datetime.fromisoformat(value.strip())
            return stamp.date() if isinstance(kind, DateType) else stamp
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")
        if isinstance(kind, (IntegerType, LongType)):
            return int(float(value))
        if isinstance(kind, DoubleType):
            return float(value)
    except (ValueError, OverflowError):
        return None
    return str(value)


def local(path: str) -> str:
    return path.removeprefix("file://")


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _files(self) -> list[str]:
        path = local(self.options["path"])
        found = sorted(glob.glob(f"{path}/*.xlsx")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(f"no .xlsx file at {path}")
        return found

    def schema(self) -> StructType:
        """Without a given schema the first file's header, all columns as text."""
        with open(self._files()[0], "rb") as f:
            header = next(sheet_rows(f.read()), [])
        return StructType([StructField(str(h), StringType()) for h in header if h is not None])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self._files(), schema)


class XlsxReader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType):
        self.files, self.own = files, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            rows = sheet_rows(f.read())
        header = {str(h): i for i, h in enumerate(next(rows, [])) if h is not None}
        places = [header.get(f.name) for f in self.own.fields]
        for row in rows:
            if any(x is not None for x in row):
                yield tuple(convert(row[p], f.dataType) if p is not None and p < len(row) else None for p, f in zip(places, self.own.fields, strict=True))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(XlsxSource)


def write_xlsx(path: str, header: list[str], rows: list[tuple]) -> None:
    """A minimal workbook with inline strings, numbers and serial dates."""

    def cell(value, at: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value}</v></c>'
        if isinstance(value, (dt.date, dt.datetime)):
            stamp = value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
            return f'<c r="{at}"><v>{(stamp - EPOCH) / dt.timedelta(days=1)}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    def name(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    lines = [f'<row r="{r}">' + "".join(cell(v, f"{name(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(header), *rows], 1)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
