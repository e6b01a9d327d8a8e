"""Excel workbooks as tables and tables as workbooks.

Workbooks are rows ``path, content``, as Spark's ``binaryFile`` source gives them, so that they may lie wherever Spark reads.
A task holds one packed workbook and, of each sheet, one batch of rows: sheets are parsed as a stream. The archive guard bounds
what a workbook expands to before anything is unpacked.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of an Excel archive.
MAX_ENTRIES, MAX_EXPANDED, MAX_RATIO = 5000, 100 * 1024 * 1024, 100
MAX_COLUMNS = 500
# The longest text of a cell and the most rows of a sheet that the file format allows.
MAX_TEXT, MAX_ROWS = 32767, 1048576
BATCH = 2000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROWS_SCHEMA = "path string, sheet string, row_number int, cells array<string>"


def check_archive(data: bytes) -> zipfile.ZipFile:
    """The opened archive, or an error when it is broken or would expand unsafely."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise ValueError("not a valid Excel file") from error
    entries = archive.infolist()
    packed, expanded = sum(e.compress_size for e in entries) or 1, sum(e.file_size for e in entries)
    if len(entries) > MAX_ENTRIES or expanded > MAX_EXPANDED or expanded / packed > MAX_RATIO:
        raise ValueError("Excel archive refused: unsafe expansion")
    return archive


def sheet_parts(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and archive entry of every sheet, in the workbook's order."""
    names = set(archive.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        listed = [(s.get("name"), targets.get(s.get(f"{_REL}id"), "")) for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        parts = [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in listed]
        return [(name, part) for name, part in parts if part in names]
    numbered = sorted((int(m[1]), part) for part in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", part)))
    return [(f"Sheet{number}", part) for number, part in numbered]


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _text(item: ElementTree.Element) -> str:
    """The text of a string item, its runs joined, without reading aids; ``_xHHHH_`` stands for a character."""
    runs = [t.text or "" for t in item.findall(f"{_MAIN}t")] + [t.text or "" for t in item.findall(f"{_MAIN}r/{_MAIN}t")]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(runs))


def _shared_texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    texts = []
    for _, element in ElementTree.iterparse(archive.open("xl/sharedStrings.xml")):
        if element.tag == f"{_MAIN}si":
            texts.append(_text(element))
            element.clear()
    return texts


def _cell(cell: ElementTree.Element, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        item = cell.find(f"{_MAIN}is")
        return "" if item is None else _text(item)
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    return shared[int(value.text)] if cell.get("t") == "s" else value.text


def sheet_rows(archive: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str | None]]:
    """Cells of a sheet as text, row by row; a cell that isn't there is null."""
    holder = None
    for event, element in ElementTree.iterparse(archive.open(part), events=("start", "end")):
        if event == "start" and element.tag == f"{_MAIN}sheetData":
            holder = element
        elif event == "end" and element.tag == f"{_MAIN}row":
            cells: list[str | None] = []
            for cell in element.iter(f"{_MAIN}c"):
                position = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                if position >= MAX_COLUMNS:
                    raise ValueError(f"more than {MAX_COLUMNS} columns")
                cells += [None] * (position + 1 - len(cells))
                cells[position] = _cell(cell, shared)
            yield cells
            holder.clear()


def read_workbooks(files: DataFrame, sheet: int | str | None = None, first_rows: int | None = None) -> DataFrame:
    """``path, sheet, row_number, cells`` of workbooks (``path, content``): of all sheets, or of one by number (from 1) or name.

    ``first_rows`` stops parsing each sheet there. A workbook without the wanted sheet, a broken or an unsafe one is an error.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                archive = check_archive(content.as_py())
                parts, shared = sheet_parts(archive), _shared_texts(archive)
                if sheet is not None:
                    parts = [p for i, p in enumerate(parts, 1) if sheet in (i, p[0])]
                    if not parts:
                        raise ValueError(f"no sheet {sheet!r} in {path}")
                for name, part in parts:
                    rows = enumerate(islice(sheet_rows(archive, part, shared), first_rows))
                    while chunk := list(islice(rows, BATCH)):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([path.as_py()] * len(chunk)), pa.array([name] * len(chunk)), pa.array([n for n, _ in chunk], pa.int32()),
                            pa.array([cells for _, cells in chunk], pa.list_(pa.string()))], ["path", "sheet", "row_number", "cells"])

    return files.select("path", "content").mapInArrow(read, ROWS_SCHEMA)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the workbooks in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def read_excel(files: DataFrame, sheet: int | str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The sheets of all workbooks as one table; their first rows must name the same columns.

    Cells are text; ``schema`` casts them by place, what can't be cast is null. Without any workbook the table
    is empty if ``schema`` is given, else an error. Sheets without rows are passed over.
    """
    first = read_workbooks(files, sheet, 1).where(F.size("cells") > 0)
    headers = first.groupBy("cells").agg(F.min(F.struct("path", "sheet")).alias("first")).limit(2).collect()
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if len(headers) > 1:
        raise ValueError("sheets with different columns: " + ", ".join(sorted(f"{r.first.sheet} in {r.first.path}" for r in headers)))
    names = [name or "" for name in headers[0].cells] if headers else schema.fieldNames() if schema else []
    if not names:
        raise ValueError("no workbook with a header")
    if len(names) > MAX_COLUMNS or len(set(names)) != len(names) or "" in names:
        raise ValueError("too many, unnamed or duplicate columns")
    if schema and len(schema) != len(names):
        raise ValueError(f"the sheets have {len(names)} columns, the schema {len(schema)}")
    fields = schema.fields if schema else [T.StructField(name, T.StringType()) for name in names]
    cells = [F.get("cells", F.lit(i)).try_cast(field.dataType).alias(field.name) for i, field in enumerate(fields)]
    return read_workbooks(files, sheet).where(F.col("row_number") > 0).select(*cells)


_CONTENT_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)


def _relation(target: str, kind: str) -> str:
    return (f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="{target}" '
            f'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}"/></Relationships>')


def _escaped(text: str) -> str:
    """XML text; characters that XML can't hold or would change become ``_xHHHH_``."""
    marked = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", marked))


def _cell_xml(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and value not in (float("inf"), float("-inf")):
        return f"<c><v>{value!r}</v></c>"
    text = value.isoformat(" ") if isinstance(value, datetime.datetime) else str(value)
    if len(text) > MAX_TEXT:
        raise ValueError(f"a cell holds at most {MAX_TEXT} characters")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(text)}</t></is></c>'


def workbook(rows: list[str], sheet: str) -> bytes:
    """A packed workbook of one sheet from the XML of its rows."""
    parts = {
        "[Content_Types].xml": _CONTENT_TYPES,
        "_rels/.rels": _relation("xl/workbook.xml", "officeDocument"),
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relation("worksheets/sheet1.xml", "worksheet"),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    # Very even tables pack better than the guard of readers allows, so they are stored as they are.
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", method) as archive:
            for name, text in parts.items():
                archive.writestr(name, text)
        if sum(map(len, parts.values())) < MAX_RATIO / 2 * len(buffer.getvalue()):
            break
    return buffer.getvalue()


def as_workbooks(df: DataFrame, sheet: str = "Sheet1", max_bytes: int = 16 << 20) -> DataFrame:
    """``path, content``: the rows of each partition as workbooks of at most ``max_bytes`` of XML each, without a shuffle.

    Numbers and booleans become cells of their kind, anything else text; nulls are empty cells.
    """
    names = df.columns
    header = "<row>" + "".join(_cell_xml(name) for name in names) + "</row>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, books, partition = [], 0, 0, TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"part-{partition:05d}-{books:05d}.xlsx"]), pa.array([workbook([header, *rows], sheet)], pa.binary())], ["path", "content"])

        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                row = "<row>" + "".join(map(_cell_xml, values)) + "</row>"
                if rows and (size + len(row) > max_bytes or len(rows) + 2 > MAX_ROWS):
                    yield packed()
                    rows, size, books = [], 0, books + 1
                rows.append(row)
                size += len(row)
        if rows:
            yield packed()

    return df.mapInArrow(write, "path string, content binary")
