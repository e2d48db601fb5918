"""Integer vectors in packed blocks, and query vectors sent to all of them in rounds.

Vectors are cut into blocks where they lie: no shuffle, so repeated rows or labels cannot
make a hot task. A block is one Parquet row of raw little-endian arrays. Query vectors are
packed alike and go to the tasks in rounds of bounded bytes; a task reads its blocks once
a round and keeps only its best rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamperlens.functions.columns import quoted

#: components beyond this magnitude are set to it; all smaller integers are exact doubles
LARGEST = 1 << 53
PACKED = "dim int, n int, ids binary, labels binary, v binary, lists binary"


def integer_vectors(
    rows: DataFrame, id_col: str, vector_col: str, scale: int, label: str = "CAST(0 AS BIGINT)"
) -> DataFrame:
    """(vec_id, label, v): vectors whose components are all finite, as floor(scale * x)."""
    vector = quoted(vector_col)
    return (
        rows.selectExpr(f"CAST({quoted(id_col)} AS BIGINT) AS vec_id", f"{label} AS label", f"{vector} AS raw")
        .where(
            "vec_id IS NOT NULL AND raw IS NOT NULL AND size(raw) > 0 AND "
            "forall(raw, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        )
        .selectExpr(
            "vec_id", "label",
            f"transform(raw, x -> CAST(greatest(least(floor({scale}D * CAST(x AS DOUBLE)), {LARGEST}L), "
            f"-{LARGEST}L) AS BIGINT)) AS v",
        )
    )


@dataclass
class Block:
    """Vectors of one length, ascending by id; ``lists`` sorts them by each dimension."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray  # integers, one row a vector
    lists: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return self.v.shape[1]

    @property
    def largest(self) -> int:
        return int(np.abs(self.v).max(initial=0))

    @staticmethod
    def read(row: dict) -> Block:
        n, dim = row["n"], row["dim"]
        kind = f"<i{len(row['v']) // (n * dim)}"
        lists = np.frombuffer(row["lists"], "<u2").reshape(n, dim) if row["lists"] else None
        return Block(
            np.frombuffer(row["ids"], "<i8"),
            np.frombuffer(row["labels"], "<i8"),
            np.frombuffer(row["v"], kind).reshape(n, dim).astype(np.int64),
            lists,
        )

    def packed(self) -> tuple:
        narrow = self.largest < 1 << 31
        values = self.v.astype("<i4" if narrow else "<i8").tobytes()
        lists = None if self.lists is None else self.lists.astype("<u2").tobytes()
        return self.dim, len(self.ids), self.ids.tobytes(), self.labels.tobytes(), values, lists


def pack(vectors: DataFrame, block: int, sort_lists: bool = False, most_bytes: int = 1 << 22) -> DataFrame:
    """Blocks of at most ``block`` (vec_id, label, v) rows and ``most_bytes`` of components.

    Both bound what a task holds; ``block`` is at most 65,536.
    """

    def close(held: list[tuple], dim: int) -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        labels = np.concatenate([h[1] for h in held])
        values = np.concatenate([h[2] for h in held])
        by_id = np.argsort(ids, kind="stable")
        made = Block(ids[by_id], labels[by_id], values[by_id])
        if sort_lists:
            made.lists = np.argsort(made.v, axis=0, kind="stable")
        row = made.packed()
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(row, kinds)], names=["dim", "n", "ids", "labels", "v", "lists"]
        )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        counts: dict[int, int] = {}
        for frame in frames:
            ids = np.asarray(frame.column(0)).astype(np.int64)
            labels = np.asarray(frame.column(1)).astype(np.int64)
            sizes = np.asarray(pa.compute.list_value_length(frame.column(2)))
            flat, ends = np.asarray(frame.column(2).flatten()), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                most = max(1, min(block, 1 << 16, most_bytes // (8 * dim)))
                while len(rows):
                    take, rows = np.split(rows, [most - counts.get(dim, 0)])
                    values = flat[(ends[take] - dim)[:, None] + np.arange(dim)].astype(np.int64)
                    held.setdefault(dim, []).append((ids[take], labels[take], values))
                    counts[dim] = counts.get(dim, 0) + len(take)
                    if counts[dim] == most:
                        yield close(held.pop(dim), dim)
                        del counts[dim]
            # many different lengths: close what is open before it adds up
            if sum(c * d for d, c in counts.items()) * 8 > 4 * most_bytes:
                for dim in list(held):
                    yield close(held.pop(dim), dim)
                counts.clear()
        for dim, rest in held.items():
            yield close(rest, dim)

    return vectors.select("vec_id", "label", "v").mapInArrow(run, PACKED)


def rounds(packs: DataFrame, most_bytes: int = 1 << 23) -> Iterator[list[Block]]:
    """Query blocks of a staged table, a bounded share of them at a time."""
    held, size = [], 0
    for row in packs.toLocalIterator():
        found = Block.read(row.asDict())
        weight = found.v.size * 8
        if held and size + weight > most_bytes:
            yield held
            held, size = [], 0
        held.append(found)
        size += weight
    if held:
        yield held


def joined_by_dim(blocks: list[Block], most: int) -> list[Block]:
    """Query blocks of equal length in chunks of at most ``most`` vectors."""
    out = []
    for dim in sorted({b.dim for b in blocks}):
        mine = [b for b in blocks if b.dim == dim]
        ids, labels, v = (np.concatenate([getattr(b, f) for b in mine]) for f in ("ids", "labels", "v"))
        out += [Block(ids[a : a + most], labels[a : a + most], v[a : a + most]) for a in range(0, len(ids), most)]
    return out


class Products:
    """Inner products of a query chunk with a block: exact integers.

    Doubles are exact while no sum can reach 2**53; beyond it Python's integers are used.
    """

    def __init__(self, queries: Block, held: Block):
        self.exact = queries.largest * held.largest * held.dim < 1 << 53
        kind = np.float64 if self.exact else object
        self.queries, self.held = queries.v.astype(kind), held.v.astype(kind)
        self.least = -np.inf if self.exact else -(1 << 200)

    def of(self, rows: np.ndarray | slice, columns: np.ndarray | slice) -> np.ndarray:
        return self.queries[rows] @ self.held[columns].T


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond their range are set to its ends."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores.ravel()], np.int64).reshape(scores.shape)


def best_of_groups(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, group))
    sorted_group = group[order]
    opens = np.ones(len(order), bool)
    opens[1:] = sorted_group[1:] != sorted_group[:-1]
    begin = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def contenders(good: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the good scores that reach the k-th good one of their row."""
    if scores.dtype == object or good.shape[1] <= k:
        return np.nonzero(good)
    shown = np.where(good, scores, -np.inf)
    kth = np.partition(shown, good.shape[1] - k, axis=1)[:, -k]
    return np.nonzero(good & (shown >= kth[:, None]))
