"""Records of delimited files whose quoted values run over line ends, cut in parallel.

A line inside a quoted value looks like any other line, so a task that starts in the middle
of a file cannot know where its first record begins. But it can say what its split does to
either state, outside or inside a quoted value, and these answers compose:

1. every split is scanned from both states (:func:`scan_splits`): one row for each split;
2. the states are handed from split to split of a file, on those rows alone;
3. every split is cut from its known state (:func:`cut_records`). Records that cross a
   split end come as fragments, at most two for each split, and are joined by their owner,
   the split they begin in.

A quote opens a value only at the start of a field, so a stray one inside a field changes
nothing. Lines end in ``\\n`` or ``\\r\\n``. A value whose quote is never closed runs to the
end of its file, without the last line end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = (
    "file string, start bigint, from_outside boolean, from_inside boolean, begins boolean, "
    "bare_return boolean, header binary"
)
PIECES = "file string, start bigint, seq bigint, owner bigint, piece bigint, record binary"


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted value is open at the end of ``line``, given whether one was at its start."""
    if b'"' not in line:
        return inside
    at, opening = 0, sep + b'"'
    while True:
        if not inside:
            if line.startswith(b'"', at):
                at += 1
            else:
                at = line.find(opening, at)
                if at < 0:
                    return False
                at += len(opening)
        close = line.find(b'"', at)
        while close >= 0 and line.startswith(b'"', close + 1):
            close = line.find(b'"', close + 2)
        if close < 0:
            return True
        at = line.find(sep, close + 1)
        if at < 0:
            return False
        at, inside = at + len(sep), False


def raw_lines(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """(file, start of the split, line as bytes), in the order of each split."""
    return spark.read.text(files, lineSep="\n").selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS start", "CAST(value AS BINARY) AS line"
    )


def _by_split(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes | None]]:
    """Lines of a task; a line of None closes each split."""
    last = None
    for frame in frames:
        for split in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2).to_pylist()):
            if last is not None and last != split[:2]:
                yield *last, None
            last = split[:2]
            yield split
    if last is not None:
        yield *last, None


def scan_splits(lines: DataFrame, sep: str) -> DataFrame:
    """One row for each split: the state it ends in from either state it may start in.

    ``begins``: a record begins in it even if it starts inside a value. ``header``: the
    first record that is not blank, of a file's first split.
    """
    mark = sep.encode()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, begins, bare, header, done = [False, True], False, False, [], False
        for file, start, line in _by_split(frames):
            if line is None:
                first = b"\n".join(header).removesuffix(b"\r") if start == 0 else None
                row = (file, start, *states, begins, bare, first)
                kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in zip(row, kinds)],
                    names=["file", "start", "from_outside", "from_inside", "begins", "bare_return", "header"],
                )
                states, begins, bare, header, done = [False, True], False, False, [], False
                continue
            begins |= not states[1]
            bare = bare or b"\r" in line[:-1]
            states = [ends_inside(line, state, mark) for state in states]
            if start == 0 and not done and (header or line.strip()):
                header.append(line)
                done = not states[0]

    return lines.mapInArrow(run, SPLITS)


def start_states(splits: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, start) -> (inside a value there, split its open record began in)."""
    out, file, inside, owner = {}, None, False, 0
    for split in sorted(splits, key=lambda s: (s.file, s.start)):
        if split.file != file:
            file, inside, owner = split.file, False, split.start
        out[file, split.start] = (inside, owner)
        if split.begins or not inside:
            owner = split.start
        inside = split.from_inside if inside else split.from_outside
    return out


def cut_records(lines: DataFrame, sep: str, states: dict[tuple[str, int], tuple[bool, int]]) -> DataFrame:
    """(file, start, seq, record): every record that is not blank, as bytes.

    ``start`` and ``seq`` order the records of a file. ``states`` has one small entry for
    each split.
    """
    mark = sep.encode()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, here = 0, None
        for file, start, line in _by_split(frames):
            if here != (file, start):
                here, seq, held = (file, start), 0, []
                inside, owner = states[here]
                tail = inside  # the first record belongs to an earlier split
            if line is None:
                if held:  # the record goes on in the next split, or is the unclosed last one
                    rows.append((file, start, None if tail else seq, owner if tail else start, start, b"\n".join(held)))
            else:
                inside = ends_inside(line, inside, mark)
                held.append(line)
                size += len(line) + 1
                if not inside:
                    record = b"\n".join(held)
                    if tail:
                        rows.append((file, start, None, owner, start, record))
                    elif record.strip():
                        rows.append((file, start, seq, None, None, record))
                        seq += 1
                    held, tail = [], False
            if size > 1 << 22:
                yield _pieces(rows)
                rows, size = [], 0
        if rows:
            yield _pieces(rows)

    pieces = lines.mapInArrow(run, PIECES)
    whole = pieces.where("owner IS NULL").select("file", "start", "seq", "record")
    joined = (
        pieces.where("owner IS NOT NULL")
        .groupBy("file", "owner")
        .agg(F.max("seq").alias("seq"), F.expr("sort_array(collect_list(struct(piece, record)))").alias("parts"))
        .selectExpr(
            "file", "owner AS start", "seq",
            "aggregate(slice(parts, 2, size(parts)), parts[0].record, (a, p) -> concat(a, X'0A', p.record)) AS record",
        )
    )
    # the carriage return of the record's own line end
    return whole.unionByName(joined).withColumn(
        "record", F.expr("if(right(hex(record), 2) = '0D', substring(record, 1, octet_length(record) - 1), record)")
    )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in PIECES.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
