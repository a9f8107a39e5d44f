"""Readers (S1-S3): CSV/parquet feeds and bulk ``.xlsx`` workbooks.

CSV is read with every column as text (no schema inference pass over the
data); typing happens in cleaning (C1/C2) with ``try_cast``, so a bad value
becomes null instead of failing the job.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import cut_lineage

SUPPORTED = (".csv", ".parquet", ".xlsx")


def detect_format(path: str) -> str:
    p = path.lower().rstrip("/")
    for ext in SUPPORTED:
        if p.endswith(ext) or p.endswith(ext + "/*"):
            return ext[1:]
    raise ValueError(f"Unsupported file format: {path}")   # S3


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """Dispatch on extension (or ``fmt``); CSV header row, text columns, quotes
    doubled inside quoted fields. ``multi_line`` reads line breaks inside quotes,
    for which a file can't be split."""
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        return (spark.read.option("header", True).option("mode", "PERMISSIVE")
                .option("inferSchema", False)
                .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path))
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "xlsx":
        return read_workbooks(spark, path)
    raise ValueError(f"Unsupported file format: {path}")


# --- S2: xlsx (Office Open XML) without a workbook library -------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


#: Number formats of the file format that show a date or a time.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_LITERAL = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.', re.I)      # quoted, escaped, [Red], padding


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for f in root.findall("m:numFmts/m:numFmt", _NS):
        if re.search("[dmyhs]", _LITERAL.sub("", f.get("formatCode") or ""), re.I):
            dates.add(int(f.get("numFmtId")))
    return {i for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)) if int(xf.get("numFmtId") or 0) in dates}


def _date_text(serial: str, from_1904: bool) -> str:
    """A day number as ISO text (as it is, if it is none)."""
    try:
        days = float(serial)
        # day 60 of the 1900 calendar is a 29 February that never was
        start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if days >= 60 else 31)
        return (start + dt.timedelta(seconds=round(days * 86400))).isoformat(" ")
    except (ValueError, OverflowError):
        return serial


def header_names(row: list[str | None]) -> list[str]:
    """Column names of a header row; a name met again (in any case) gets .1, .2, ..."""
    seen: dict[str, int] = {}
    out = []
    for h in ("" if v is None else str(v) for v in row):
        n = seen.get(h.lower(), 0)
        seen[h.lower()] = n + 1
        out.append(f"{h}.{n}" if h and n else h)
    return out


_M = f"{{{_NS['m']}}}"
_ROW, _CELL, _VALUE, _TEXT = (f"{_NS['m']}}}{tag}" for tag in ("row", "c", "v", "t"))       # as the parser names them
CHUNK_BYTES = 1 << 16                # of a sheet's XML parsed at a time


def _texts(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_M}t"))


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """The elements of one name in a part of the file, one at a time: what was read is let go of."""
    with z.open(name) as f:
        path: list[ET.Element] = []
        for event, el in ET.iterparse(f, events=("start", "end")):
            if event == "start":
                path.append(el)
                continue
            path.pop()
            if el.tag == tag:
                yield el
                path[-1].clear()


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text (the first is the header), streamed from the file's XML. Only the workbook's
    shared strings are held."""
    z = zipfile.ZipFile(io.BytesIO(data))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rid = wb.find("m:sheets/m:sheet", _NS).get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.findall("pr:Relationship", _NS) if r.get("Id") == rid).lstrip("/")
    target = target if target.startswith("xl/") else "xl/" + target
    shared = [_texts(si) for si in _elements(z, "xl/sharedStrings.xml", f"{_M}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    dates = _date_styles(z)
    properties = wb.find("m:workbookPr", _NS)
    from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    with z.open(target) as f:
        yield from _Sheet(shared, dates, from_1904).rows(f)


class _Sheet:
    """Rows of a sheet's XML. The parser calls back for tags and texts: no tree is built."""
    def __init__(self, shared: list[str], dates: set[int], from_1904: bool):
        self.shared, self.dates, self.from_1904 = shared, dates, from_1904
        self.columns: dict[str, int] = {}                     # a reference's letters -> its column
        self.done: list[list[str | None]] = []                # rows read and not given out yet
        self.cells: dict[int, str | None] | None = None       # of the row that is open
        self.depth = self.row_depth = self.cell_depth = 0
        self.type: str | None = None
        self.style: str | None = None
        self.at = 0
        self.inline: list[str] = []                           # texts of the cell's t elements
        self.value: list[str] | None = None                   # texts of its first v element
        self.reading: list[str] | None = None                 # where texts go
        self.reading_depth = 0

    def rows(self, f) -> Iterator[list[str | None]]:
        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.text
        while data := f.read(CHUNK_BYTES):
            parser.Parse(data, False)
            yield from self.taken()
        parser.Parse(b"", True)
        yield from self.taken()

    def taken(self) -> list[list[str | None]]:
        done, self.done = self.done, []
        return done

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.depth += 1
        if tag == _CELL:
            if self.cells is not None and self.depth == self.row_depth + 1:
                self.cell_depth = self.depth
                self.type, self.style, self.value = attributes.get("t"), attributes.get("s"), None
                self.inline = []
                ref = attributes.get("r")
                if ref:
                    letters = _REF.match(ref).group(1)
                    at = self.columns.get(letters)
                    if at is None:
                        at = self.columns[letters] = _col_index(letters)
                    self.at = at
                else:
                    self.at = len(self.cells)
        elif tag == _ROW:
            if self.cells is None:
                self.cells, self.row_depth = {}, self.depth
        elif self.cell_depth:
            if tag == _TEXT:
                if self.type == "inlineStr":
                    self.reading, self.reading_depth = self.inline, self.depth
            elif tag == _VALUE and self.value is None and self.depth == self.cell_depth + 1:
                self.value = []
                self.reading, self.reading_depth = self.value, self.depth

    def text(self, data: str) -> None:
        if self.reading is not None and self.depth == self.reading_depth:
            self.reading.append(data)

    def end(self, tag: str) -> None:
        if self.reading is not None and self.depth == self.reading_depth:
            self.reading = None
        elif tag == _CELL and self.depth == self.cell_depth:
            self.cells[self.at] = self.cell()
            self.cell_depth = 0
        elif tag == _ROW and self.depth == self.row_depth:
            cells, self.cells, self.row_depth = self.cells, None, 0
            self.done.append([cells.get(i) for i in range(max(cells) + 1 if cells else 0)])
        self.depth -= 1

    def cell(self) -> str | None:
        if self.type == "inlineStr":
            return "".join(self.inline)
        if not self.value:
            return None
        val = "".join(self.value)
        if self.type == "s":
            return self.shared[int(val)]
        if self.type == "b":
            return "True" if val == "1" else "False"
        if self.type in (None, "n") and int(self.style or 0) in self.dates:
            return _date_text(val, self.from_1904)
        return val


ROWS_AT_ONCE = 4096
WORKBOOK_ROWS = "path string, row bigint, head array<string>, cells array<string>"


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows (path, row, head, cells) of the first sheet of every workbook in ``files`` (path, content): row 0 is the
    header alone (cells null), ``head`` is repeated on every row. A file is opened once and streamed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.list_(pa.string())

        def batch(path: str, first: int, head: list[str], cells: list) -> pa.RecordBatch:
            n = len(cells)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n, type=pa.string()), pa.array(range(first, first + n), type=pa.int64()),
                 pa.array([head] * n, type=text), pa.array(cells, type=text)], names=["path", "row", "head", "cells"])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = sheet_rows(content.as_py())
                head = header_names(next(rows, []))
                yield batch(path, 0, head, [None])
                at, held = 1, []
                for r in rows:
                    held.append(r)
                    if len(held) == ROWS_AT_ONCE:
                        yield batch(path, at, head, held)
                        at, held = at + len(held), []
                if held:
                    yield batch(path, at, head, held)
    return files.select("path", "content").mapInArrow(run, WORKBOOK_ROWS)


def read_workbooks(spark: SparkSession, glob: str) -> DataFrame:
    """Many workbooks in parallel, each opened once. Rows are written as (head, cells) and read back as text under
    the union of headers; names that differ only in case are one column."""
    return united_rows(cut_lineage(workbook_rows(spark.read.format("binaryFile").load(glob))))


def layouts(table: DataFrame) -> list[list[str]]:
    """The distinct headers of a written table of ``workbook_rows``: one row per file is read."""
    return sorted(list(r["head"]) for r in table.where("row = 0").select("head").distinct().collect())


def united_rows(table: DataFrame) -> DataFrame:
    """Rows of a written table of ``workbook_rows`` under the union of headers, furthest left first."""
    first: dict[str, tuple[int, str]] = {}
    for head in layouts(table):
        for at, name in enumerate(head):
            if name:
                key = name.lower()
                first[key] = min(first.get(key, (at, name)), (at, name))
    lower = F.transform("head", F.lower)
    cols = [F.get("cells", F.array_position(lower, key) - 1).alias(name) for key, (_, name) in sorted(first.items(), key=lambda i: i[1])]
    return table.where("row > 0").select(*(cols or [F.lit(None).cast("string").alias("_empty")]))


# --- feeds by header ---------------------------------------------------------
def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path or pattern, by the file system that Spark reads it with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(conf), []
    for status in fs.globStatus(at) or []:
        found = fs.listFiles(status.getPath(), True)
        while found.hasNext():
            p = found.next().getPath()
            if not p.getName().startswith(("_", ".")):
                out.append(p.toString())
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def csv_header(spark: SparkSession, file: str) -> list[str]:
    """Column names of a CSV file, from its first line."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return header_names(next(csv.reader([line.lstrip("\ufeff")]), [])) if line else []


def by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> CSV files that have it. First lines are read side by side on the driver; no data is."""
    files = [f for p in paths for f in files_of(spark, p)]
    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(lambda f: tuple(csv_header(spark, f)), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for f, h in zip(files, heads):
        out.setdefault(h, []).append(f)
    return out


def read_csv_files(spark: SparkSession, files: list[str], header: tuple[str, ...], multi_line: bool = False) -> DataFrame:
    """CSV files of one header as one scan, all columns text."""
    schema = T.StructType([T.StructField(c or f"_c{i}", T.StringType()) for i, c in enumerate(header)])
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(files))
