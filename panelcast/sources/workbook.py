"""Bulk ingest of .xlsx workbooks as a Spark job.

``binaryFile`` lists and reads the workbooks; ``mapInPandas`` opens each one
(stdlib ``zipfile`` + ``xml.etree``, one workbook per task) and emits long
cells ``(path, sheet, row, col, value)``; the header row names the columns;
rows are pivoted back to one all-string row per sheet row.  Numeric cells with
a date number format become ``yyyy-MM-dd`` text (Excel serial days from
1899-12-30).  A damaged file raises ``ValueError`` naming the path (or is
reported in an ``errors`` table with ``on_error="report"``).
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
# built-in number formats that display dates
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
CELL_SCHEMA = "path string, sheet string, row long, col long, value string, error string"
EXCEL_EPOCH = dt.datetime(1899, 12, 30)


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = set()
    for nf in root.findall("m:numFmts/m:numFmt", NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        if "y" in code or "d" in code:
            custom.add(int(nf.get("numFmtId")))
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in DATE_FORMAT_IDS or fid in custom:
            out.add(i)
    return out


def _read_cells(path: str, data: bytes, sheet_name: str | None):
    z = zipfile.ZipFile(io.BytesIO(data))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("rel:Relationship", NS)}
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
    dates = _date_styles(z)
    for sh in wb.findall("m:sheets/m:sheet", NS):
        name = sh.get("name")
        if sheet_name is not None and name != sheet_name:
            continue
        t = target[sh.get(f"{{{NS['r']}}}id")].lstrip("/")
        t = t if t.startswith("xl/") else "xl/" + t
        root = ET.fromstring(z.read(t))
        for row in root.findall("m:sheetData/m:row", NS):
            r = int(row.get("r")) - 1
            for c in row.findall("m:c", NS):
                kind, style = c.get("t"), int(c.get("s", "0"))
                v = c.find("m:v", NS)
                if kind == "inlineStr":
                    text = "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t"))
                elif v is None:
                    continue
                elif kind == "s":
                    text = shared[int(v.text)]
                elif kind in ("str", "e", "b") or style not in dates:
                    text = v.text
                else:
                    text = (EXCEL_EPOCH + dt.timedelta(days=float(v.text))).strftime("%Y-%m-%d")
                yield (path, name, r, _col_index(c.get("r")), text, None)


def _cells(sheet_name: str | None):
    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.extend(_read_cells(path, bytes(content), sheet_name))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as exc:
                    out.append((path, None, None, None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "col", "value", "error"])
    return run


def read_workbook_cells(spark: SparkSession, paths: str, sheet_name: str | None = None) -> DataFrame:
    """Long cells of every matching workbook (one task per workbook file)."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "content").mapInPandas(_cells(sheet_name), CELL_SCHEMA)


def read_workbooks(spark: SparkSession, paths: str, sheet_name: str | None = None, *,
                   on_error: str = "raise") -> DataFrame:
    """All-string table: one row per data row of the chosen sheet, columns
    named by the header row (first row), plus ``path``."""
    cells = read_workbook_cells(spark, paths, sheet_name)
    errors = cells.where(F.col("error").isNotNull()).select("path", "error")
    if on_error == "raise":
        bad = errors.limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['path']} is no readable .xlsx workbook ({bad[0]['error']}); "
                             "export it anew from the spreadsheet program")
    good = cells.where(F.col("error").isNull())
    header = good.where(F.col("row") == 0).select("path", "sheet", "col", F.col("value").alias("name"))
    # a column's name comes from its own file: workbooks may order their columns differently
    body = good.where(F.col("row") > 0).join(header, ["path", "sheet", "col"])
    names = [r["name"] for r in header.groupBy("name").agg(F.min("col").alias("col")).orderBy("col", "name").collect()]
    return body.groupBy("path", "sheet", "row").pivot("name", names).agg(F.first("value"))
