"""Workbook files: calculation chains and first-sheet tables.

Every parser takes (path, content) rows as ``binaryFile`` yields them, so the
files are divided among tasks and each is read on its own.
"""

from __future__ import annotations

import datetime
import functools
import io
import itertools
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamperlens.llm.common import bounded_batches
from tamperlens.operators.calcchain import fill_sheet_ids
from tamperlens.plans.staging import stage
from tamperlens.sources.tabular import typed

_PIECE = 50_000  # cells handed to Spark at a time

CHAIN_SCHEMA = "path string, sheet_id string, index bigint, cell_ref string"
CELL_SCHEMA = "path string, sheet string, row bigint, column string, column_index int, value string"


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the .xlsx files below ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )


@functools.lru_cache(4096)
def _without_namespace(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _local_name(element) -> str:
    return _without_namespace(element.tag)


def _elements(archive: zipfile.ZipFile, member: str, name: str) -> Iterator:
    """Elements of one name in document order, whatever their namespace."""
    with archive.open(member) as stream:
        for _, element in ElementTree.iterparse(stream):
            if _local_name(element) == name:
                yield element
                element.clear()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many files together, so that small files share a batch."""
    while piece := list(itertools.islice(rows, _PIECE)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, field.type) for values, field in zip(zip(*piece), schema)], schema=schema
        )


def _chain_rows(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if "xl/calcChain.xml" in archive.namelist():
            for index, cell in enumerate(_elements(archive, "xl/calcChain.xml", "c")):
                yield path, cell.get("i"), index, cell.get("r")


def _column_index(letters: str) -> int:
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter) - ord("A") + 1
    return index


def _first_sheet(archive: zipfile.ZipFile) -> tuple[str, str]:
    """Name and member of the first sheet in workbook order."""
    members = set(archive.namelist())
    if "xl/workbook.xml" in members and "xl/_rels/workbook.xml.rels" in members:
        targets = {
            r.get("Id"): r.get("Target")
            for r in _elements(archive, "xl/_rels/workbook.xml.rels", "Relationship")
        }
        for sheet in _elements(archive, "xl/workbook.xml", "sheet"):
            link = next((v for k, v in sheet.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)
            if link in targets:
                target = targets[link]
                member = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
                return sheet.get("name") or "Sheet1", member
    return "Sheet1", "xl/worksheets/sheet1.xml"


#: fixed values: built-in number formats that show dates or times
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _shows_dates(code: str) -> bool:
    """Whether a custom number format shows a date or time."""
    shown = re.sub(r'"[^"]*"|\\.|[_*].', "", code.split(";")[0])
    # brackets hold colours, places and conditions, or hours and the like that run on
    shown = re.sub(r"\[(?!(?:h+|m+|s+)\])[^\]]*\]", "", shown, flags=re.IGNORECASE)
    return shown.strip().lower() != "general" and bool(re.search("[dmyhs]", shown, re.IGNORECASE))


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose values are dates or times."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    custom, styles = {}, set()
    with archive.open("xl/styles.xml") as stream:
        for element in ElementTree.parse(stream).getroot():
            if _local_name(element) == "numFmts":
                custom = {f.get("numFmtId"): f.get("formatCode") or "" for f in element}
            elif _local_name(element) == "cellXfs":
                formats = [f.get("numFmtId") or "0" for f in element]
                styles = {
                    i for i, f in enumerate(formats)
                    if (_shows_dates(custom[f]) if f in custom else f.isdigit() and int(f) in DATE_FORMATS)
                }
    return styles


def _counts_from_1904(archive: zipfile.ZipFile) -> bool:
    if "xl/workbook.xml" not in archive.namelist():
        return False
    return any(p.get("date1904") in ("1", "true") for p in _elements(archive, "xl/workbook.xml", "workbookPr"))


def _date_text(value: str, from_1904: bool) -> str:
    """A day count as date, date and time, or time of day; what is none stays as it is."""
    try:
        days = float(value)
        if not 0 <= days < 2_958_466:  # the year 9999
            return value
    except ValueError:
        return value
    time = datetime.timedelta(milliseconds=round((days % 1) * 86_400_000))
    if days < 1 and time:
        return str(datetime.datetime.min + time)[11:]
    # the calendar of 1900 has a day too many, the 60th
    first = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30 if days >= 60 else 31)
    found = first + datetime.timedelta(days=int(days)) + time
    return str(found) if time else str(found.date())


def _cell_value(cell, shared: list[str], dates: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    texts = {"v": [], "t": []}
    for part in cell.iter():
        if _local_name(part) in texts:
            texts[_local_name(part)].append(part.text or "")
    if kind == "inlineStr":
        return "".join(texts["t"])
    if not texts["v"]:
        return None
    value = texts["v"][0]
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and int(cell.get("s") or 0) in dates:
        return _date_text(value, from_1904)
    return value


def _cell_rows(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for item in _elements(archive, "xl/sharedStrings.xml", "si"):
                shared.append("".join(t.text or "" for t in item.iter() if _local_name(t) == "t"))
        sheet, member = _first_sheet(archive)
        dates, from_1904 = _date_styles(archive), _counts_from_1904(archive)
        for row in _elements(archive, member, "row"):
            for cell in row:
                match = re.match(r"([A-Z]+)([0-9]+)", cell.get("r") or "")
                if match:
                    value = _cell_value(cell, shared, dates, from_1904)
                    if value is not None:
                        letters, number = match.groups()
                        yield path, sheet, int(number), letters, _column_index(letters), value


_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, EOFError, zlib.error)


def _over_files(files: DataFrame, rows_of, schema: str, errors: bool = False) -> DataFrame:
    """The rows of files, or (path, error) of broken ones.

    Rows are handed on piece by piece, so no file is held as rows; the pieces before
    that of a break in a file count.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for frame in frames:
            for path, content in zip(frame.column(0), frame.column(1)):
                path = path.as_py()
                found = rows_of(path, content.as_py())
                try:
                    while piece := list(itertools.islice(found, _PIECE)):
                        if not errors:
                            yield from piece
                except _BROKEN as failure:
                    if errors:
                        yield path, f"{type(failure).__name__}: {failure}"

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(lambda frames: _batches(rows(frames), arrow), schema)


def unreadable_workbooks(files: DataFrame) -> DataFrame:
    """(path, error) of files whose chain or first sheet cannot be read to its end."""

    def everything(path: str, content: bytes) -> Iterator[tuple]:
        yield from _chain_rows(path, content)
        yield from _cell_rows(path, content)

    schema = "path string, error string"
    return _over_files(files, everything, schema, errors=True)


def parse_calc_chains(files: DataFrame) -> DataFrame:
    """(path, sheet_id, index, cell_ref) of every chain entry in file order.

    A sheet id that is left out repeats the one before; a broken file or one
    without a chain gives no rows.
    """
    return fill_sheet_ids(stage(_over_files(files, _chain_rows, CHAIN_SCHEMA)))


def read_calc_chains(spark: SparkSession, path: str) -> DataFrame:
    """F1 over the workbooks of a folder."""
    return parse_calc_chains(workbook_files(spark, path))


def parse_workbook_cells(files: DataFrame) -> DataFrame:
    """A3: first-sheet cells as (path, sheet, row, column, column_index, value)."""
    return _over_files(files, _cell_rows, CELL_SCHEMA)


def _free_names(given: list[str]) -> list[str]:
    """Names of one workbook's columns from left to right, each once whatever its case."""
    lowers = [name.lower() for name in given]
    taken, names, seen = set(lowers), [], set()
    for name, lower in zip(given, lowers):
        free, number = name, 2
        if lower in seen:
            while (free := f"{name}_{number}").lower() in taken:
                number += 1
            taken.add(free.lower())
        seen.add(lower)
        names.append(free)
    return names


def _name_columns(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, columns, names) of one workbook a row: the names made free."""
    for frame in frames:
        path, columns, given = (frame.column(i) for i in range(3))
        free = pa.array([_free_names(names) for names in given.to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([path, columns, free], names=["path", "columns", "names"])


def workbook_tables(cells: DataFrame) -> DataFrame:
    """A3: cells to one table: (path, sheet_row, header columns…), typed by their values.

    The first row of each workbook names its columns; workbooks may have them in
    different places.  A name that stands several times in a workbook gets the
    number of its repetition, a column without a name that of its place
    (``column_3``), and the next number where a name is taken, so no cell is lost.
    Cells in a date format are dates, timestamps or times of day.  The names are the columns of the result,
    so they are what reaches the driver.
    """
    staged = stage(cells)
    # one row per workbook, then per column of it: staged, so that their size decides the join
    tops = stage(staged.groupBy("path").agg(F.min("row").alias("_top")))
    placed = staged.join(tops, "path")
    given = "max(if(row = _top, value, NULL))"
    headers = stage(
        placed.groupBy("path", "column_index")
        .agg(F.expr(f"coalesce(nullif(trim({given}), ''), concat('column_', column_index)) AS _given"))
        .groupBy("path")  # a sheet has at most 16,384 columns
        .agg(F.sort_array(F.collect_list(F.struct("column_index", "_given"))).alias("_h"))
        .select("path", F.col("_h.column_index").alias("columns"), F.col("_h._given").alias("names"))
        .mapInArrow(_name_columns, "path string, columns array<int>, names array<string>")
        .selectExpr("path", "inline(arrays_zip(columns, names))")
        .selectExpr("path", "columns AS column_index", "names AS _name")
    )
    named = placed.filter("row > _top").join(headers, ["path", "column_index"])
    order = headers.groupBy("_name").agg(F.min("column_index").alias("_i")).orderBy("_i", "_name")
    names = [r["_name"] for r in order.collect()]
    table = (
        named.groupBy("path", F.col("row").alias("sheet_row"))
        .pivot("_name", names)
        .agg(F.first("value"))
    )
    return typed(stage(table), ("path", "sheet_row"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A3 over the workbooks of a folder."""
    return workbook_tables(parse_workbook_cells(workbook_files(spark, path)))
