"""XLSX sheets as tables, read by Spark tasks.

A sheet holds at most 1 048 576 rows by its format, so one task per sheet is
bounded.  Tasks give cells as text together with the kind of each cell; the
column types are then decided by a Spark aggregation over those kinds.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as XML

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names as N
from .tables import tidy

# Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BUILTIN_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

SHEETS = "path string, sheet string, position int, part string, sheets int"
CELLS = "path string, sheet string, row long, cells array<string>, kinds array<string>"


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = XML.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    root = XML.fromstring(book.read("xl/workbook.xml"))
    return [
        (s.get("name"), posixpath.normpath(posixpath.join("/xl", targets[s.get(REL_ID)])).lstrip("/"))
        for s in root.iter(MAIN + "sheet")
    ]


def _list_sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            parts = _sheet_parts(zipfile.ZipFile(io.BytesIO(content)))
            yield pd.DataFrame(
                [(path, name, i, part, len(parts)) for i, (name, part) in enumerate(parts)],
                columns=["path", "sheet", "position", "part", "sheets"],
            )


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = XML.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in root.iter(MAIN + "si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = XML.fromstring(book.read("xl/styles.xml"))
    dated = set(BUILTIN_DATE_FORMATS)
    for fmt in root.iter(MAIN + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            dated.add(int(fmt.get("numFmtId")))
    used = root.find(MAIN + "cellXfs")
    return {i for i, xf in enumerate(used if used is not None else []) if int(xf.get("numFmtId", 0)) in dated}


def _cell(node: XML.Element, texts: list[str], dated: set[int], epoch: datetime) -> tuple[str | None, str | None]:
    form, raw = node.get("t", "n"), node.findtext(MAIN + "v")
    if form == "inlineStr":
        return "".join(t.text or "" for t in node.iter(MAIN + "t")), "text"
    if raw is None or form == "e":
        return None, None
    if form == "s":
        return texts[int(raw)], "text"
    if form == "b":
        return ("true" if raw == "1" else "false"), "bool"
    if form in ("str", "d"):
        return raw, "text" if form == "str" else "date"
    if int(node.get("s", 0)) in dated:
        return (epoch + timedelta(days=float(raw))).isoformat(sep=" ", timespec="microseconds"), "date"
    return raw, "number"


def _column_number(ref: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", ref).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _read_sheet(content: bytes, part: str, batch: int = 5000) -> Iterator[list[tuple[int, list, list]]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    texts, dated = _shared_texts(book), _date_styles(book)
    in_1904 = 'date1904="1"' in book.read("xl/workbook.xml").decode("utf-8", "replace")
    epoch = datetime(1904, 1, 1) if in_1904 else datetime(1899, 12, 30)
    rows: list[tuple[int, list, list]] = []
    with book.open(part) as stream:
        for _, row in XML.iterparse(stream):
            if row.tag != MAIN + "row":
                continue
            cells: dict[int, tuple[str | None, str | None]] = {}
            for i, node in enumerate(row.iter(MAIN + "c")):
                cells[_column_number(node.get("r")) if node.get("r") else i] = _cell(node, texts, dated, epoch)
            row_number = int(row.get("r", 0))
            row.clear()
            if any(kind for _, kind in cells.values()):
                width = max(cells) + 1
                filled = [cells.get(i, (None, None)) for i in range(width)]
                rows.append((row_number, [v for v, _ in filled], [k for _, k in filled]))
                if len(rows) >= batch:
                    yield rows
                    rows = []
    if rows:
        yield rows


def _read_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, sheet, part, content in zip(batch["path"], batch["sheet"], batch["part"], batch["content"]):
            for rows in _read_sheet(content, part):
                out = pd.DataFrame(rows, columns=["row", "cells", "kinds"])
                out.insert(0, "sheet", sheet)
                out.insert(0, "path", path)
                yield out


def workbook_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sheets, cells) of all workbooks under a path; every sheet is read by its own task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    sheets = files.mapInPandas(_list_sheets, SHEETS)
    work = files.join(sheets, "path").repartition("path", "sheet")
    return sheets, work.select("path", "sheet", "part", "content").mapInPandas(_read_cells, CELLS)


def read_workbook(spark: SparkSession, path: str) -> list[tuple[str | None, DataFrame]]:
    """(sheet label, table) of every sheet with at least one data row; one sheet alone has no label."""
    sheets, cells = workbook_cells(spark, path)
    listing = sheets.orderBy("path", "position").collect()
    first = cells.groupBy("path", "sheet").agg(
        F.min_by("cells", "row").alias("header"), F.min("row").alias("header_row"),
        F.count(F.lit(1)).alias("rows"),
    )
    headers = {(r["path"], r["sheet"]): r for r in first.collect()}
    body = cells.join(F.broadcast(first.select("path", "sheet", "header_row")), ["path", "sheet"]).filter(
        F.col("row") > F.col("header_row")
    )
    kinds = (
        body.select("path", "sheet", F.posexplode("kinds").alias("pos", "kind"))
        .filter(F.col("kind").isNotNull())
        .groupBy("path", "sheet", "pos")
        .agg(F.collect_set("kind").alias("kinds"))
    )
    found = {(r["path"], r["sheet"], r["pos"]): set(r["kinds"]) for r in kinds.collect()}
    casts = {"number": "double", "bool": "boolean", "date": "timestamp_ntz"}

    tables = []
    for entry in listing:
        key = (entry["path"], entry["sheet"])
        head = headers.get(key)
        if head is None or head["rows"] < 2:
            continue
        last = max([len(head["header"]) - 1] + [p for (f, s, p) in found if (f, s) == key])
        given = list(head["header"]) + [None] * (last + 1 - len(head["header"]))
        names = N.tidy_headers([h if h is not None else f"Unnamed: {i}" for i, h in enumerate(given)])
        rows = body.filter((F.col("path") == entry["path"]) & (F.col("sheet") == entry["sheet"]))

        def typed(i: int):
            kind = found.get((*key, i), set())
            value = F.get("cells", F.lit(i))
            only = next(iter(kind)) if len(kind) == 1 else "text"
            return (value.cast(casts[only]) if only in casts else value).alias(names[i])

        tables.append((entry["sheet"] if entry["sheets"] > 1 else None,
                       tidy(rows.select(*[typed(i) for i in range(len(names))]))))
    return tables
