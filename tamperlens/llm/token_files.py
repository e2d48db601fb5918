"""Token files: ids of all documents in ascending id order, Simple-8b coded.

A file is one row (part, file, ids_before, documents, ids, content) of a Parquet table in
the given folder; ``content`` is the file of :mod:`simple8b`. Parts follow each other in
document order, and so do the files of a part. Texts are sorted once by range; rows of one
id are told apart by their text, so no key fills a task. Null texts are empty, null ids
come first, repeated rows stay, and an empty table gives no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import bounded_batches, parts_by_size
from tamperlens.llm.simple8b import read_file, write_file
from tamperlens.llm.tokens import drop_encoders, worker_encoder

FILES = "part int, file int, ids_before bigint, documents bigint, ids bigint, content binary"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each document, and the lengths with it."""
    out = np.empty(len(ids) + len(lengths), np.uint32)
    lengths = lengths + 1
    ends = np.cumsum(lengths) - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[ends] = end_id
    out[body] = ids
    return out, lengths


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    ids_per_file: int = 1 << 20,
) -> None:
    """Write the token files of all documents; files close at about ``ids_per_file`` ids."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        part, file, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal file, before, held
            ids, keys, known, lengths = (np.concatenate(x) for x in zip(*held))
            content = write_file(ids, keys, known, lengths)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([file], pa.int32()),
                    pa.array([before], pa.int64()), pa.array([len(keys)], pa.int64()),
                    pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary()),
                ],
                names=["part", "file", "ids_before", "documents", "ids", "content"],
            )
            file, before, held = file + 1, before + len(ids), []
            return row

        for frame in frames:
            keys = frame.column(0)
            for begin, end in _slices(frame.column(1), min(1 << 20, 4 * ids_per_file)):
                key = keys.slice(begin, end - begin)
                ids, lengths = encoder.encode(frame.column(1).slice(begin, end - begin).to_pylist())
                ids, lengths = with_end(ids, lengths, end_id)
                held.append(
                    (ids, np.asarray(key.fill_null(0)), np.asarray(key.is_valid()), lengths)
                )
                if sum(len(x[0]) for x in held) >= ids_per_file:
                    yield close()
        if held:
            yield close()

    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(
        f"CAST({quoted(id_col)} AS BIGINT) AS doc_id", f"CAST({quoted(text_col)} AS STRING) AS text"
    ).withColumn("tie", F.xxhash64("text"))
    (
        rows.repartitionByRange(*parts_by_size(rows), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(run, FILES)
        .write.parquet(folder)
    )


def _slices(texts: pa.Array, most: int):
    """Ranges of an Arrow text column of about ``most`` bytes, at least one text each."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, base + most, side="right")), begin + 1)
        yield begin, end
        begin = end


def read_token_files(spark: SparkSession, folder: str, ids_per_batch: int = 1 << 18) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) decoded from the files of a folder.

    ``ids`` are little-endian unsigned 32-bit integers. ``start`` counts all ids of earlier documents. Only one total for each part of the
    writing job is collected to lay the parts end to end.
    """
    files = spark.read.schema(FILES).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "part int, part_start bigint")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for frame in frames:
            for content, begin in zip(frame.column(0), frame.column(1)):
                ids, keys, known, lengths = read_file(content.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                flat, first = ids.astype("<u4"), 0
                while first < len(keys):  # documents of about a megabyte of ids at a time
                    base = ends[first] - lengths[first]
                    last = max(int(np.searchsorted(ends, base + ids_per_batch, side="right")), first + 1)
                    some = slice(first, last)
                    offsets = pa.py_buffer(np.append(0, 4 * (ends[some] - base)).astype(np.int32))
                    each = pa.BinaryArray.from_buffers(
                        pa.binary(), last - first, [None, offsets, pa.py_buffer(flat[base : ends[last - 1]].tobytes())]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[some], pa.int64(), mask=~known[some]),
                            pa.array(begin.as_py() + ends[some] - lengths[some], pa.int64()),
                            pa.array(lengths[some], pa.int64()),
                            each,
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    first = last

    return (
        files.join(F.broadcast(starts), "part")  # one row for each part
        .selectExpr("content", "part_start + ids_before AS start")
        .mapInArrow(run, ROWS)
    )
