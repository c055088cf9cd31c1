"""Excel (.xlsx) first-sheet reader without openpyxl.

Workbooks are read as binary files and parsed per task by ``mapInPandas``
with the standard library (zip + XML): one workbook per task, so many
workbooks read in parallel.  Cells come out as text (type inference
follows); they meet by the header's names, so workbooks may hold other
columns or another order."""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_RID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook lists first; without a workbook
    part, the sheet of the lowest number."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        first = ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        parts = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = parts.get(first.get(_RID)) if first is not None else None
        if target:
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            if path in names:
                return path
    numbered = [(int(m.group(1)), n) for n in names if (m := re.match(r"xl/worksheets/sheet(\d+)\.xml$", n))]
    if not numbered:
        raise ValueError("workbook holds no sheet")
    return min(numbered)[1]


def table_of(data: bytes) -> tuple[list[str], list[list]]:
    """Column names and rows, as wide as the widest row: cells without a header
    are ``column_i``, a repeated name gets the suffix ``.1``, ``.2`` and so on."""
    rows = parse_first_sheet(data)
    head, body = (rows[0], rows[1:]) if rows else ([], [])
    width = max([len(head), *map(len, body)], default=0)
    names, seen = [], set()
    for i in range(width):
        given = name = (head[i] if i < len(head) else None) or f"column_{i}"
        k = 0
        while name in seen:
            k += 1
            name = f"{given}.{k}"
        seen.add(name)
        names.append(name)
    return names, [r + [None] * (width - len(r)) for r in body]


def parse_first_sheet(data: bytes) -> list[list]:
    """Rows (lists of text or None) of the first worksheet."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    root = ET.fromstring(z.read(_first_sheet(z)))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        vals = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "inlineStr":
                is_ = c.find("m:is", _NS)
                text = "".join(x.text or "" for x in is_.iter(f"{{{_NS['m']}}}t")) if is_ is not None else None
            elif v is None:
                text = None
            elif t == "s":
                text = shared[int(v.text)]
            elif t == "b":
                text = "True" if v.text == "1" else "False"
            else:
                text = v.text
            vals[_col_index(c.get("r"))] = text
        if vals:
            width = max(vals) + 1
            rows.append([vals.get(i) for i in range(width)])
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Read every workbook under ``path``; the columns (all text) are those of
    any workbook, in order of first place, then name.  Only the distinct column
    names reach the driver."""
    files = spark.read.format("binaryFile").load(path)

    def headers(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame([(n, i) for blob in pdf["content"] for i, n in enumerate(table_of(bytes(blob))[0])],
                               columns=["name", "place"])

    places = files.select("content").mapInPandas(headers, "name string, place int").groupBy("name") \
        .agg(F.min("place").alias("place")).collect()
    if not places:
        raise ValueError("no workbook with a header found")
    names = [r["name"] for r in sorted(places, key=lambda r: (r["place"], r["name"]))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches):
        import pandas as pd
        for pdf in batches:
            for blob in pdf["content"]:
                have, rows = table_of(bytes(blob))
                yield pd.DataFrame(rows, columns=have, dtype=object).reindex(columns=names).astype(object) \
                    .where(lambda f: f.notna(), None)

    return files.select("content").mapInPandas(parse, schema)
