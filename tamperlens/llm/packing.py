"""Packing along a space-filling curve.

Each document's hashed vector of byte trigrams is projected to a few dimensions; its cell
there has a Hilbert key. Documents are range-sorted by that key, so neighbours in content
are neighbours in the sort, and each sorted part is cut into sequences of ``length`` ids
as it is read: documents run on from one sequence to the next, so only the last sequence
of a part has free places. Ids are made after the sort and are never shuffled.

Null texts are empty (they still get their end id), null ids and repeated rows are packed
like any other, an empty table gives no rows. Rows of one key are sorted by id and text
hash, so copies spread over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import bounded_batches, parts_by_size
from tamperlens.llm.token_files import _slices, with_end
from tamperlens.llm.tokens import worker_encoder

KEYED = "doc_id bigint, text string, curve_key bigint, tie bigint"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_SEQUENCE_BITS = 33


class Projection:
    """Hashed trigram vectors of 2**16 places, projected to ``dims`` by a fixed random map."""

    def __init__(self, dims: int = 3, bits: int = 10, scale: float = 0.25, seed: int = 5):
        self.dims, self.bits, self.scale = dims, bits, scale
        self.map = np.random.default_rng(seed).standard_normal((dims, 1 << 16)).astype(np.float32)

    def cells(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Grid cell of each text; ``data`` has two spare bytes after the last text."""
        wide = data.astype(np.uint16)
        code = wide[:-2] * np.uint16(7919) + wide[1:-1] * np.uint16(31337) + wide[2:] * np.uint16(257)
        out = np.zeros((len(starts), self.dims), np.int64)
        filled = sizes > 0
        if not filled.any():
            return out
        for d in range(self.dims):
            total = np.add.reduceat(self.map[d][code], starts[filled], dtype=np.float64)
            mean = total / sizes[filled]
            # a smooth squash keeps every vector inside the grid
            place = (1 + mean / np.sqrt(self.scale**2 + mean**2)) / 2
            out[filled, d] = np.minimum((place * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
        return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each cell along the Hilbert curve of its dimension (transposed form)."""
    axes = [cells[:, d].copy() for d in range(cells.shape[1])]
    top = 1 << (bits - 1)
    side = top
    while side > 1:  # undo the rotations, from the coarsest square to the finest
        low = side - 1
        for d in range(len(axes)):
            high = (axes[d] & side) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0]) ^ swap
            if d:
                axes[d] = axes[d] ^ swap
        side >>= 1
    for d in range(1, len(axes)):
        axes[d] ^= axes[d - 1]
    flip = np.zeros(len(cells), np.int64)
    side = top
    while side > 1:
        flip = np.where((axes[-1] & side) != 0, flip ^ (side - 1), flip)
        side >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> bit) & 1)
    return key


def curve_keys(docs: DataFrame, id_col: str, text_col: str, projection: Projection) -> DataFrame:
    """Rows (doc_id, text, curve_key, tie); whole texts count."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for begin, end in _slices(frame.column(1), 1 << 20):
                part = frame.slice(begin, end - begin)
                texts = part.column(1)
                sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
                data = b"".join(t.as_buffer() for t in texts if t.is_valid)
                starts = np.cumsum(sizes) - sizes
                cells = projection.cells(np.frombuffer(data + b"\0\0", np.uint8), starts, sizes)
                keys = pa.array(hilbert_keys(cells, projection.bits), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), texts, keys, part.column(2)],
                    names=["doc_id", "text", "curve_key", "tie"],
                )

    rows = docs.selectExpr(
        f"CAST({quoted(id_col)} AS BIGINT) AS doc_id",
        f"coalesce(CAST({quoted(text_col)} AS STRING), '') AS text",
        f"xxhash64({quoted(text_col)}) AS tie",
    )
    return rows.mapInArrow(run, KEYED)


def cut(lengths: np.ndarray, filled: int, most: int):
    """Pieces of documents laid end to end after ``filled`` ids of an open sequence.

    Returns (document, start in it, length, sequence from 0, offset in it) arrays.
    """
    ends = filled + np.cumsum(lengths)
    begins = ends - lengths
    marks = np.arange(-(-filled // most) * most, ends[-1] if len(ends) else 0, most)
    left = np.unique(np.concatenate((begins, marks[marks >= filled])))
    right = np.append(left[1:], ends[-1]) if len(left) else left
    doc = np.searchsorted(ends, left, side="right")
    return doc, left - begins[doc], right - left, left // most, left % most


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    projection: Projection | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all sequences.

    ``ids`` are little-endian unsigned 32-bit integers; a sequence's pieces follow each
    other by ``offset`` without a gap.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        first = TaskContext.get().partitionId() << _SEQUENCE_BITS
        done, filled = 0, 0  # closed sequences, ids in the open one
        for frame in frames:
            for begin, end in _slices(frame.column(1), 1 << 20):
                ids, sizes = encoder.encode(frame.column(1).slice(begin, end - begin).to_pylist())
                ids, sizes = with_end(ids, sizes, end_id)
                doc, start, size, sequence, offset = cut(sizes, filled, length)
                bounds = pa.py_buffer(np.append(0, 4 * np.cumsum(size)).astype(np.int32))
                content = pa.BinaryArray.from_buffers(
                    pa.binary(), len(doc), [None, bounds, pa.py_buffer(ids.astype("<u4").tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(begin, end - begin).take(pa.array(doc)),
                        pa.array(start, pa.int64()),
                        pa.array(size, pa.int64()),
                        content,
                        pa.array(sizes[doc], pa.int64()),
                        pa.array(first + done + sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                total = filled + int(sizes.sum())
                done, filled = done + total // length, total % length

    bounded_batches(docs.sparkSession)
    return (
        curve_keys(docs, id_col, text_col, projection or Projection())
        .repartitionByRange(*parts_by_size(docs), "curve_key", "doc_id", "tie")
        .sortWithinPartitions("curve_key", "doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(run, PIECES)
    )
