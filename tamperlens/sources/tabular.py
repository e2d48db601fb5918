"""Delimited text and JSON tables."""

from __future__ import annotations

import csv
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperlens.functions.columns import quoted, text_literal
from tamperlens.sources.records import cut_records, raw_lines, scan_splits, start_states

#: fixed values: texts that stand for a missing value
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# one bit for each kind of value; a column's bits together decide its type
INT, BIG, WIDE, REAL, BOOL, DAY, TIME, TEXT = (1 << i for i in range(8))
#: encodings in which quotes, separators and line ends are single ASCII bytes
SPLITTABLE = ("UTF-8", "ISO-8859-1", "US-ASCII")
FILE, START, ORDER = "source_file", "source_block", "source_order"


def _value(column: str) -> str:
    marks = ", ".join(text_literal(m) for m in MISSING)
    return f"if({quoted(column)} IN ({marks}), NULL, {quoted(column)})"


def _kind(column: str) -> str:
    c = quoted(column)
    return (
        f"CASE WHEN {c} IS NULL THEN 0 "
        f"WHEN {c} RLIKE '^[+-]?[0-9]+$' THEN CASE WHEN try_cast({c} AS INT) IS NOT NULL THEN {INT} "
        f"WHEN try_cast({c} AS BIGINT) IS NOT NULL THEN {BIG} WHEN length({c}) <= 38 THEN {WIDE} ELSE {TEXT} END "
        f"WHEN {c} RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN {REAL} "
        f"WHEN lower({c}) IN ('true', 'false') THEN {BOOL} "
        f"WHEN {c} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND try_cast({c} AS DATE) IS NOT NULL THEN {DAY} "
        f"WHEN {c} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]' AND try_cast({c} AS TIMESTAMP) IS NOT NULL "
        f"THEN {TIME} ELSE {TEXT} END"
    )


def _type_of(bits: int) -> str:
    """Narrowest type that holds every value exactly as written; wide ids never turn to DOUBLE."""
    for kinds, name in (
        (INT, "int"), (INT | BIG, "bigint"), (INT | BIG | WIDE, "decimal(38,0)"), (INT | BIG | REAL, "double"),
        (BOOL, "boolean"), (DAY, "date"), (DAY | TIME, "timestamp"),
    ):
        if bits and not bits & ~kinds:
            return name
    return "string"


def typed(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns as the types their values have; marks of missing values become NULL.

    One pass looks at every value of every column.
    """
    names = [c for c in raw.columns if c not in keep]
    cleaned = raw.selectExpr(*[quoted(c) for c in keep], *[f"{_value(c)} AS {quoted(c)}" for c in names])
    if not names:
        return cleaned
    found = cleaned.agg(*[F.expr(f"bit_or({_kind(c)}) AS k{i}") for i, c in enumerate(names)]).first()
    kinds = {c: _type_of(found[f"k{i}"] or 0) for i, c in enumerate(names)}
    return cleaned.selectExpr(
        *[
            quoted(c) if kinds.get(c, "string") == "string" else f"try_cast({quoted(c)} AS {kinds[c]}) AS {quoted(c)}"
            for c in raw.columns
        ]
    )


def first_lines(lines: DataFrame, line: str, place: str) -> list:
    """(file, line) of the smallest ``place`` of each file.

    The aggregate holds one number for each file. One that holds the lines themselves
    would sort all lines of a task.
    """
    places = lines.groupBy("file").agg(F.min(place).alias(place))
    return lines.join(F.broadcast(places), ["file", place]).select("file", line).collect()


def _file_sets(spark: SparkSession, path: str, encoding: str | None) -> dict[tuple, list[str]]:
    """Files by (encoding, whether a quoted value may run over a line end, header line).

    One row for each file reaches the driver, as it does for Spark's own listing.
    """
    lines = spark.read.text(path).selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start = 0 AND trim(value) <> '' AS opens",
        "monotonically_increasing_id() AS place", "value",
    )
    flags = lines.groupBy("file").agg(
        F.expr("bool_and(is_valid_utf8(value)) AS utf8"),
        F.expr("bool_or(length(value) % 2 <> length(replace(value, '\"', '')) % 2) AS runs_on"),
    ).collect()
    opening = lines.where("opens").selectExpr("file", "place", "CAST(value AS BINARY) AS value")
    heads = {row.file: bytes(row.value) for row in first_lines(opening, "value", "place")}
    sets: dict[tuple, list[str]] = {}
    for row in flags:
        coding = encoding or ("UTF-8" if row.utf8 else "ISO-8859-1")
        # the header of a file with such values is its first record, not its first line
        kind = (coding, row.runs_on, None if row.runs_on else heads.get(row.file, b""))
        sets.setdefault(kind, []).append(unquote(row.file))
    return sets


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header record: free ones for empty and repeated names."""
    found = next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep), [])
    counts = Counter(name.lower() for name in found)
    names, taken = [], set()
    for i, name in enumerate(found):
        free = f"_c{i}" if not name else f"{name}{i}" if counts[name.lower()] > 1 else name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        names.append(free)
    return names


def _lines_as_records(spark: SparkSession, files: list[str] | str, sep: str, coding: str) -> DataFrame:
    """Files in which no record runs over a line end, through Spark's own reader."""
    table = spark.read.csv(files, header=True, sep=sep, encoding=coding, quote='"', escape='"')
    return table.selectExpr(
        f"_metadata.file_path AS {FILE}", f"_metadata.file_block_start AS {START}",
        f"monotonically_increasing_id() AS {ORDER}", *[quoted(c) for c in table.columns],
    )


def _cut_tables(spark: SparkSession, files: list[str], sep: str, coding: str) -> list[DataFrame]:
    """Files with values that run over line ends: one table for each header.

    They are split like any other; only files whose lines end in a bare carriage return,
    and encodings in which a quote is not one known byte, are read whole.
    """
    whole: list[str] = []
    if coding.upper() not in SPLITTABLE:
        files, whole = [], files
    lines = raw_lines(spark, files) if files else None
    splits = scan_splits(lines, sep).collect() if files else []  # one row for each split
    bare = {s.file for s in splits if s.bare_return}
    whole += [unquote(f) for f in bare]
    by_header: dict[bytes, list[str]] = {}
    for split in splits:
        if split.start == 0 and split.file not in bare:
            by_header.setdefault(bytes(split.header or b""), []).append(split.file)
    states = start_states([s for s in splits if s.file not in bare])
    tables = []
    for header, group in by_header.items():
        names = header_names(header.decode(coding, "replace"), sep)
        # the same splits as in the scan: a smaller set of files might be split otherwise
        known = spark.createDataFrame([(f,) for f in group], "file string")
        own = lines if len(by_header) == 1 and not bare else lines.join(F.broadcast(known), "file", "left_semi")
        records = cut_records(own, sep, states).where("start <> 0 OR seq <> 0")
        schema = ", ".join(f"{quoted(f'f{i}')} STRING" for i in range(len(names))) or "f0 STRING"
        options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
        fields = F.from_csv(F.expr(f"decode(record, '{coding.upper()}')"), schema, options)
        tables.append(
            records.select(
                F.col("file").alias(FILE), F.col("start").alias(START), F.col("seq").alias(ORDER), fields.alias("fields")
            ).selectExpr(FILE, START, ORDER, *[f"fields.f{i} AS {quoted(n)}" for i, n in enumerate(names)])
        )
    if whole:
        table = spark.read.csv(
            whole, header=True, sep=sep, encoding=coding, multiLine=True, quote='"', escape='"'
        )
        tables.append(
            table.selectExpr(
                f"_metadata.file_path AS {FILE}", f"_metadata.file_block_start AS {START}",
                f"monotonically_increasing_id() AS {ORDER}", *[quoted(c) for c in table.columns],
            )
        )
    return tables


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: str | T.StructType | None = None,
    encoding: str | None = None,
    file_order: bool = False,
) -> DataFrame:
    """A1: header from each file, types from the values, UTF-8 or else Latin-1 file by file.

    Files may have their columns in any order, or other columns. Files in which a quoted
    value runs over a line end are split too (:mod:`tamperlens.sources.records`).
    ``file_order`` adds ``source_file``, ``source_block`` and ``source_order``, whose order
    is the order of the rows in the files.
    """
    tables = []
    sets = _file_sets(spark, path, encoding)
    for (coding, runs_on, _), files in sets.items():
        if runs_on:
            tables += _cut_tables(spark, files, sep, coding)
        else:  # all files alike: read the path as it was given
            tables.append(_lines_as_records(spark, path if len(sets) == 1 else files, sep, coding))
    if not tables:
        tables = [_lines_as_records(spark, path, sep, encoding or "UTF-8")]
    return _together(tables, schema, (FILE, START, ORDER) if file_order else ())


def _together(
    tables: list[DataFrame], schema: str | T.StructType | None, place: tuple[str, ...], kept: tuple[str, ...] = ()
) -> DataFrame:
    """Union by name of tables of text columns, typed by their values or by ``schema``'s order."""
    skipped = {FILE, START, ORDER, *kept}
    if schema is not None:
        tables = [
            t.selectExpr(
                *place, *[c for c in kept if c in t.columns],
                *[
                    f"try_cast({_value(have)} AS {kind}) AS {quoted(name)}"
                    for have, (name, kind) in zip([c for c in t.columns if c not in skipped], _fields(schema))
                ],
            )
            for t in tables
        ]
    raw = tables[0]
    for more in tables[1:]:
        raw = raw.unionByName(more, allowMissingColumns=True)
    if schema is not None:
        return raw
    raw = raw.selectExpr(*place, *[quoted(c) for c in raw.columns if c not in (FILE, START, ORDER)])
    return typed(raw, (*place, *[c for c in kept if c in raw.columns]))


def in_file_order() -> list[Column]:
    """Sort keys of rows read with ``file_order``, for ``with_row_id``."""
    return [F.col(FILE), F.col(START), F.col(ORDER)]


def sniff_delimiter(line: str) -> str | None:
    """Tab, comma or semicolon if the line has one, ``None`` for blanks."""
    for sep in ("\t", ",", ";"):
        if sep in line:
            return sep
    return None


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: str | T.StructType | None = None,
    file_order: bool = False,
) -> DataFrame:
    """A2: .tsv and .txt; the delimiter is read off the first line.

    Blank-separated text is split on runs of blanks; every file's first line is its header.
    If a line has more fields than its header, a column ``extra_fields`` holds what is left
    over. ``file_order`` as in :func:`read_csv`.
    """
    lines = spark.read.text(path).selectExpr(
        "_metadata.file_path AS file", f"_metadata.file_block_start AS {START}",
        f"monotonically_increasing_id() AS {ORDER}", "trim(value) AS line",
    ).where("line <> ''")
    heads = sorted(first_lines(lines.where(f"{START} = 0"), "line", ORDER))  # one row for each file
    if sep is None and heads:
        sep = sniff_delimiter(heads[0].line)
    if sep is not None or not heads:
        return read_csv(spark, path, sep or ",", schema, file_order=file_order)
    by_header: dict[str, list[str]] = {}
    for head in heads:
        by_header.setdefault(head.line, []).append(head.file)
    tables, kept = [], ()
    for header, files in by_header.items():
        names = header_names(",".join(f'"{n}"' for n in header.replace('"', '""').split()), ",")
        own = lines
        if len(by_header) > 1:
            known = spark.createDataFrame([(f,) for f in files], "file string")
            own = lines.join(F.broadcast(known), "file", "left_semi")
        # one header line per file: the first one
        rows = own.where(f"NOT ({START} = 0 AND line = {text_literal(header)})").selectExpr(
            f"file AS {FILE}", START, ORDER, r"split(line, r'\s+') AS parts"
        )
        width = len(_fields(schema)) if schema is not None else len(names)
        extra = []
        if not rows.where(f"size(parts) > {width}").isEmpty():
            extra, kept = [f"slice(parts, {width + 1}, size(parts)) AS extra_fields"], ("extra_fields",)
        named = names if schema is None else [n for n, _ in _fields(schema)]
        tables.append(
            rows.selectExpr(FILE, START, ORDER, *extra, *[f"get(parts, {i}) AS {quoted(n)}" for i, n in enumerate(named)])
        )
    return _together(tables, schema, (FILE, START, ORDER) if file_order else (), kept)


def _fields(schema: str | T.StructType) -> list[tuple[str, str]]:
    parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return [(f.name, f.dataType.simpleString()) for f in parsed.fields]


def _document_schema(spark: SparkSession, files: list[str] | str) -> T.StructType | None:
    """Schema of files that hold a document each, inferred from their texts.

    Spark's own look at such files packs them by bytes alone, so thousands of small ones
    are one task.
    """
    texts = spark.read.text(files, wholetext=True)
    found = spark.read.json(texts.rdd.map(lambda row: row.value)).schema
    return found if found.fields else None


def read_json(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    multi_line: bool | None = None,
    file_order: bool = False,
) -> DataFrame:
    """A5: a JSON array or object per file, or one object per line.

    Without ``multi_line`` each file is looked at: if every line that is not blank
    is a whole object, it is read line by line, else as one document.  ``file_order``
    as in :func:`read_csv`.
    """
    plain = False  # whether all files are known to be UTF-8 text

    def read(files: list[str] | str, whole: bool) -> DataFrame:
        kinds = _document_schema(spark, files) if schema is None and whole and plain else schema
        reader = spark.read.schema(kinds) if kinds is not None else spark.read
        rows = reader.json(files, multiLine=whole)
        if not file_order:
            return rows
        return rows.selectExpr(
            f"_metadata.file_path AS {FILE}", f"_metadata.file_block_start AS {START}",
            f"monotonically_increasing_id() AS {ORDER}", *[quoted(c) for c in rows.columns],
        )

    if multi_line is not None:
        return read(path, multi_line)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    by_file = (
        lines.filter("line <> ''")
        .groupBy("file")
        .agg(
            F.expr("bool_and(line LIKE '{%}' AND try_parse_json(line) IS NOT NULL) AS by_line"),
            F.expr("bool_and(is_valid_utf8(line) AND NOT contains(line, '\\0') AND NOT contains(line, '\ufeff')) AS plain"),
        )
        .collect()  # one row for each file
    )
    plain = all(r.plain for r in by_file)
    if len({r.by_line for r in by_file}) <= 1:
        return read(path, not (by_file and by_file[0].by_line))
    kinds = [[unquote(r.file) for r in by_file if r.by_line == kind] for kind in (True, False)]
    return read(kinds[0], False).unionByName(read(kinds[1], True), allowMissingColumns=True)


def read_table(spark: SparkSession, path: str, file_order: bool = False) -> DataFrame:
    """Reader by extension, as far as the table readers go.

    ``file_order`` as in :func:`read_csv`; rows of workbooks have ``sheet_row`` anyway.
    """
    name = path.lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, file_order=file_order)
    if name.endswith((".tsv", ".txt")):
        return read_delimited(spark, path, file_order=file_order)
    if name.endswith(".json"):
        return read_json(spark, path, file_order=file_order)
    if name.endswith(".xlsx"):
        from tamperlens.sources.workbooks import read_workbooks

        return read_workbooks(spark, path)
    raise ValueError(f"unsupported file type: {path}")
