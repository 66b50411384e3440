"""Spreadsheet files as tab-separated text, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REF = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_text(data: bytes, sheet_name: str | None = None) -> str:
    """The cells of a sheet (the first by default), tab-separated."""
    book = zipfile.ZipFile(io.BytesIO(data))
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
    sheet = next((s for s in sheets if sheet_name is None or s.get("name") == sheet_name), None)
    if sheet is None:
        raise ValueError(f"no sheet {sheet_name}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    lines: list[str] = []
    for row in ElementTree.fromstring(book.read("xl/" + targets[sheet.get(_REF)].removeprefix("/xl/"))).iter(f"{_MAIN}row"):
        lines += [""] * (int(row.get("r", len(lines) + 1)) - 1 - len(lines))
        cells: list[str] = []
        for c in row.findall(f"{_MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            value = c.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
        lines.append("\t".join(cells))
    return "\n".join(lines)


def sheets_as_text(spark: SparkSession, paths: list[str], sheet_name: str | None = None) -> DataFrame:
    """(file, text) of spreadsheets, read in the tasks."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sheet_text(x, sheet_name) for x in b.column(1).to_pylist()], pa.string())], ["file", "text"])

    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content").mapInArrow(run, "file string, text string")
