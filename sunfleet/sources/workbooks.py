"""Excel workbooks (Office Open XML) as registries: first sheets read on executors, small tables written as one file."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Rows of a sheet at most, by the format.
MOST_ROWS = 1_048_576


def column_number(reference: str) -> int:
    """0 for A, 26 for AA, of a cell's name like AA7."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text, row by row; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for row in ET.fromstring(book.read(sheets[0])).iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                at = column_number(cell.get("r")) if cell.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            out.append(cells)
        return out


def read_workbooks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of `schema` of first sheets, whose first row has the names; a column that a sheet lacks is NULL, as is a number
    of another form. `path` may be a glob; a workbook is read by one task."""
    fields = spark.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                head, *rows = sheet_rows(bytes(content)) or [[]]
                at = {name: i for i, name in reversed(list(enumerate(head)))}
                pick = lambda row, name: row[at[name]] if name in at and at[name] < len(row) else None
                yield pd.DataFrame({name: pd.Series([pick(r, name) for r in rows], dtype=object) for name in names})

    text = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, text)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def write_workbook(df: DataFrame, path: str) -> None:
    """One local file with a sheet of df, streamed through the driver; ValueError with more rows than a sheet holds."""
    if df.count() >= MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows")

    def cell(i: int, row: int, value) -> str:
        name = f"{column_name(i)}{row}"
        if value is None or value != value:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{name}"><v>{value!r}</v></c>'
        return f'<c r="{name}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    pack = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main, head = _MAIN.strip("{}"), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for k, row in enumerate([df.columns]):
                out.write(f'<row r="{k + 1}">{"".join(cell(i, k + 1, v) for i, v in enumerate(row))}</row>'.encode())
            for k, row in enumerate(df.toLocalIterator(), 2):
                out.write(f'<row r="{k}">{"".join(cell(i, k, v) for i, v in enumerate(row))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")
