"""Sheets of XLSX workbooks as DataFrames.

``spark.read.format("xlsx")`` (after ``register``) plans a partition for each sheet of each file; a sheet is one compressed stream of
at most a million rows, so one task reads it, and only the columns of the schema are taken from it. Options: ``sheet``, a name or ``*`` for
all (else the first one); ``ordinal``, a column for each row's number in its sheet; ``sheet_column``, one for the sheet's name. Columns are text
unless a schema says otherwise; what doesn't fit a number is null, and a column that a sheet lacks is too. Paths are those of Arrow's file systems (local,
HDFS, S3, GCS), files or folders of them. ``read_sheet`` reads one sheet from any file system of Spark's, through the file's bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows in one Arrow batch.
ROWS = 10_000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """0-based column of a cell like B7."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


class Workbook:
    def __init__(self, data: bytes | io.IOBase | pa.NativeFile):
        self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        self.sheets = {s.get("name"): "xl/" + rels[s.get(_REL)].removeprefix("/xl/") for s in sheets}
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for item in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                self.shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        with self.zip.open(self.sheets[sheet]) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{_MAIN}row":
                    out: list[str | None] = []
                    for k, cell in enumerate(node.iter(f"{_MAIN}c")):
                        at = _column(cell.get("r")) if cell.get("r") else k
                        out += [None] * (at + 1 - len(out))
                        out[at] = self._value(cell)
                    yield out
                    node.clear()

    def _value(self, cell: ElementTree.Element) -> str | None:
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        value = cell.find(f"{_MAIN}v")
        if value is None or value.text is None:
            return None
        return self.shared[int(value.text)] if cell.get("t") == "s" else value.text


def _names(header: list[str | None]) -> list[str]:
    """Names of a header's cells; an empty one's by its place, a repeated one with a number."""
    names: list[str] = []
    for i, name in enumerate(header, 1):
        name, n = name or f"column_{i}", 1
        while (name if n == 1 else f"{name}_{n}") in names:
            n += 1
        names.append(name if n == 1 else f"{name}_{n}")
    return names


def _file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def sheet_columns(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Each sheet's header, in the order of the workbook; reads one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                book = Workbook(content.as_py())
                headers = [_names(next(book.rows(s), [])) for s in book.sheets]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(headers)), pa.int32()), pa.array(list(book.sheets)), pa.array(headers, pa.list_(pa.string()))], names=["nth", "sheet", "columns"])

    found = _file(spark, path).mapInArrow(run, "nth int, sheet string, columns array<string>")
    return {r["sheet"]: list(r["columns"]) for r in sorted(found.collect())}


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, ordinal: str | None = None) -> DataFrame:
    """A sheet (the first one, unless named) below its header; with each row's number in it as ``ordinal``."""
    sheets = sheet_columns(spark, path)
    sheet = sheet or next(iter(sheets))
    names = sheets[sheet]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[list[str | None]], last: int) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(range(last - len(rows), last), pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "nth"])

        for batch in batches:
            for content in batch.column(0):
                rows = Workbook(content.as_py()).rows(sheet)
                next(rows, None)
                part, n = [], 0
                for row in rows:
                    part.append((row + [None] * len(names))[: len(names)])
                    n += 1
                    if len(part) == ROWS:
                        yield given(part, n)
                        part = []
                yield given(part, n)

    found = _file(spark, path).mapInArrow(run, ", ".join([*(f"c{i} string" for i in range(len(names))), "nth long"]))
    return found.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)), *([F.col("nth").alias(ordinal)] if ordinal else []))


def _file_system(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"[a-z0-9]+:", path) else (pf.LocalFileSystem(), path)


def _workbooks(path: str) -> Iterator[tuple[str, Workbook]]:
    """The workbooks at a path, in order, each open while it is looked at."""
    system, place = _file_system(path)
    files = [place]
    if system.get_file_info(place).type == pf.FileType.Directory:
        files = sorted(f.path for f in system.get_file_info(pf.FileSelector(place, recursive=True)) if f.type == pf.FileType.File and f.base_name.endswith(".xlsx"))
    for file in files:
        with system.open_input_file(file) as stream:
            yield file, Workbook(stream)


def _number(text: str | None, kind: type) -> float | int | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if kind is float else int(x) if x.is_integer() else None


class Sheet(InputPartition):
    def __init__(self, file: str, sheet: str):
        self.file, self.sheet = file, sheet


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.fields, self.options = schema.fields, dict(options)

    def _chosen(self, book: Workbook) -> list[str]:
        asked = self.options.get("sheet")
        return list(book.sheets) if asked == "*" else [s for s in book.sheets if s == asked] if asked else list(book.sheets)[:1]

    def partitions(self) -> list[Sheet]:
        return [Sheet(file, sheet) for file, book in _workbooks(self.options["path"]) for sheet in self._chosen(book)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.options["path"])
        with system.open_input_file(partition.file) as stream:
            rows = Workbook(stream).rows(partition.sheet)
            header = {name: i for i, name in enumerate(_names(next(rows, [])))}
            at = [header.get(f.name) for f in self.fields]  # only these cells are kept
            kept: list[list[str | None]] = []
            nth = 0
            for row in rows:
                kept.append([row[i] if i is not None and i < len(row) else None for i in at])
                if len(kept) == ROWS:
                    yield self._batch(kept, nth, partition.sheet)
                    nth, kept = nth + len(kept), []
            if kept:
                yield self._batch(kept, nth, partition.sheet)

    def _batch(self, rows: list[list[str | None]], nth: int, sheet: str) -> pa.RecordBatch:
        columns = []
        for k, field in enumerate(self.fields):
            values = [r[k] for r in rows]
            if field.name == self.options.get("ordinal"):
                columns.append(pa.array(range(nth, nth + len(rows)), pa.int64()))
            elif field.name == self.options.get("sheet_column"):
                columns.append(pa.array([sheet] * len(rows), pa.string()))
            elif isinstance(field.dataType, T.DoubleType):
                columns.append(pa.array([_number(v, float) for v in values], pa.float64()))
            elif isinstance(field.dataType, T.LongType):
                columns.append(pa.array([_number(v, int) for v in values], pa.int64()))
            else:
                columns.append(pa.array(values, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.fields])


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        """The union of the chosen sheets' headers as text, in order of appearance."""
        reader, names = SheetReader(T.StructType(), self.options), {}
        for _, book in _workbooks(self.options["path"]):
            for sheet in reader._chosen(book):
                names |= dict.fromkeys(_names(next(book.rows(sheet), [])))
        fields = [T.StructField(n, T.StringType()) for n in names]
        fields += [T.StructField(self.options[o], kind) for o, kind in (("ordinal", T.LongType()), ("sheet_column", T.StringType())) if o in self.options]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> SheetReader:
        odd = [f.name for f in schema.fields if not isinstance(f.dataType, (T.StringType, T.DoubleType, T.LongType))]
        if odd:
            raise ValueError(f"columns of a sheet are string, double or bigint: {odd}")
        return SheetReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)


def load(spark: SparkSession, path: str, sheet: str, ordinal: str) -> DataFrame:
    """A sheet with its rows' numbers, by the data source where Arrow opens the path's file system, else through Spark's own."""
    scheme = re.match(r"([a-z0-9]+):", path)
    if scheme and scheme[1] not in ("file", "hdfs", "s3", "gs"):
        return read_sheet(spark, path, sheet, ordinal)
    register(spark)
    return spark.read.format("xlsx").option("sheet", sheet).option("ordinal", ordinal).load(path)
