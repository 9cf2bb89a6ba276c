"""Scans: records by suffix, workbooks, assets, optional tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from functools import cached_property
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """.jsonl, .json (array or object), .csv (all strings), .parquet; other suffixes are an error. Bad JSON lines fail."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "jsonl":
        return reader.option("mode", "FAILFAST").json(path)
    if suffix == "json":
        return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if suffix == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {path}")


def scan_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or no rows where the path does not exist (asked of the path's own file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return scan(spark, path, schema) if there else spark.createDataFrame([], schema)


def with_order(df: DataFrame, name: str = "row_ord") -> DataFrame:
    """A place that grows within each file; needed where the first or last row wins."""
    return df.withColumn(name, F.monotonically_increasing_id())


def clean_headers(names: list[str]) -> list[str]:
    """Blank names become unnamed_<n>; a name that is there already (whatever its case) gets the first free of __2, __3 ..."""
    out, taken = [], set()
    for i, name in enumerate(names, 1):
        free = name = name.strip() or f"unnamed_{i}"
        n = 1
        while free.lower() in taken:
            n += 1
            free = f"{name}__{n}"
        taken.add(free.lower())
        out.append(free)
    return out


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def elements(archive: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one kind of a part of the package, as a stream; each is emptied after use."""
    with archive.open(part) as xml:
        for _, found in ElementTree.iterparse(xml):
            if found.tag == f"{{{_SHEET}}}{tag}":
                yield found
                found.clear()


def texts_in(element: ElementTree.Element) -> str:
    """The text of a string item: all its runs, but no phonetic hints."""
    hints = {t for p in element.iter(f"{{{_SHEET}}}rPh") for t in p.iter(f"{{{_SHEET}}}t")}
    return "".join(t.text or "" for t in element.iter(f"{{{_SHEET}}}t") if t not in hints)


class Workbook:
    """An .xlsx package (ECMA-376): its sheets as rows of strings.

    Shared strings are read when a cell first asks for one.
    """

    def __init__(self, content: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.parts = set(self.archive.namelist())
        targets = {}
        for link in ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels")):
            to = link.get("Target", "")
            targets[link.get("Id")] = to[1:] if to.startswith("/") else posixpath.normpath(f"xl/{to}")
        self.sheets = {sheet.get("name"): targets[sheet.get(f"{{{_LINKS}}}id")] for sheet in elements(self.archive, "xl/workbook.xml", "sheet")}

    @cached_property
    def shared(self) -> list[str]:
        part = "xl/sharedStrings.xml"
        return [texts_in(item) for item in elements(self.archive, part, "si")] if part in self.parts else []

    def text_of(self, cell: ElementTree.Element) -> str:
        kind, value = cell.get("t"), cell.findtext(f"{{{_SHEET}}}v", "")
        if kind == "s":
            return self.shared[int(value)] if value else ""
        return texts_in(cell) if kind == "inlineStr" else value

    def rows(self, sheet: str | None = None) -> Iterator[list[str]]:
        """Rows with gaps filled by empty strings; the first sheet unless one is named."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(self.sheets)}")
        for row in elements(self.archive, self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values())), "row"):
            cells, following = {}, 0
            for cell in row.iter(f"{{{_SHEET}}}c"):
                place = column_index(cell.get("r", ""))
                cells[following if place is None else place] = self.text_of(cell)
                following = max(cells) + 1
            yield [cells.get(i, "") for i in range(following)]


def column_index(reference: str) -> int | None:
    """The column of a cell reference from 0: A1 -> 0, B7 -> 1, AA1 -> 26; None without letters. Letters are digits of base 26 without a zero."""
    letters = reference.rstrip("0123456789")
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else None


def file_bytes(path: str) -> bytes:
    """A file that drivers and executors can all reach, by its URI; a plain path is one on a shared mount or, on one machine, local."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(inner) as stream:
        return stream.read()


def sheet_names(path: str) -> list[str]:
    """Names of a workbook's sheets, in order."""
    return list(Workbook(file_bytes(path)).sheets)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("sheet", ...).load(path): all strings, blank rows dropped."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _open(self) -> Workbook:
        return Workbook(file_bytes(self.options["path"]))

    def schema(self) -> StructType:
        header = next(self._open().rows(self.options.get("sheet")), [])
        out = StructType()
        for name in clean_headers(header):
            out.add(name, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self._open, self.options.get("sheet"), len(schema))


class WorkbookReader(DataSourceReader):
    def __init__(self, opened, sheet: str | None, width: int) -> None:
        self.opened, self.sheet, self.width = opened, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = self.opened().rows(self.sheet)
        next(rows, None)
        for row in rows:
            if any(x.strip() for x in row):
                yield tuple((row + [""] * self.width)[: self.width])


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def asset_index(spark: SparkSession, path: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """entity_id with its sorted paths and their number, and the paths whose stem is no number. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path")
    return grouped_assets(files, "path")


def numeric_stem(path):
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when(stem.rlike(r"(?U)^\d+$"), stem)


def grouped_assets(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    named = files.select(F.col(path).alias("path"), numeric_stem(F.col(path)).alias("entity_id"))
    found = named.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.array_sort(F.collect_list("path")).alias("paths")).withColumn("n_paths", F.size("paths"))
    return found, named.filter("entity_id IS NULL").select("path")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
