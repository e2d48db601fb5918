"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers floor(scale * x) in packed blocks of bounded size, each with its
lists: the block's vectors sorted by every dimension once. A task takes a round of queries
through its blocks and walks the lists of many queries at once: downwards where a query's
weight is positive, upwards where it is negative. Vectors met are scored whole; the walk
of a query ends when the bound, the score of a vector that stood at the frontier of every
list, falls below its k-th best so far, so no unseen vector can win or tie. Where a stride
down the lists would read more entries than vectors are left, which is soon the case in
many dimensions, the rest of the block is met at once. The k-th best of earlier blocks is
the starting bound of the next ones. The best of all tasks are merged.

Vectors that are null, or hold null or non-finite components, take no part; neither do
null ids. Repeated rows of an id are separate candidates with one id, and never their own
query's. Each distinct vector of a query id asks for itself. Vectors of another length
than the query's are no candidates for it. Components beyond 2**53 count as 2**53, scores
beyond 64 bits are ranked among all and returned as the largest or smallest 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperlens.llm.common import Scratch
from tamperlens.llm.vector_blocks import (
    Block, Products, best_of_groups, contenders, integer_vectors, joined_by_dim, longs, pack, rounds,
)

FOUND = "query_id bigint, query_no bigint, vec_id bigint, score bigint, exact string"


class Best:
    """The k best (score, id) of each query of a chunk so far."""

    def __init__(self, queries: Block, k: int):
        self.k = k
        self.row = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, object)
        self.queries = len(queries.ids)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, ids = np.concatenate((self.row, rows)), np.concatenate((self.ids, ids))
        scores = np.concatenate((self.scores, scores)) if len(self.scores) else scores
        top = best_of_groups(row, scores, ids, self.k)
        self.row, self.ids, self.scores = row[top], ids[top], scores[top]

    def kth(self, least) -> np.ndarray:
        """Score of each query's k-th best; ``least`` where fewer are known."""
        out = np.full(self.queries, least, object if isinstance(least, int) else np.float64)
        ends = np.searchsorted(self.row, np.arange(self.queries), side="right")
        known = np.bincount(self.row, minlength=self.queries) == self.k
        out[known] = self.scores[ends[known] - 1]
        return out


def threshold_walk(queries: Block, held: Block, best: Best, step: int) -> int:
    """Walk a block's lists for all queries of a chunk; returns the vectors met, over all queries."""
    n, dim = held.v.shape
    products = Products(queries, held)
    values = np.take_along_axis(products.held, held.lists.astype(np.int64), axis=0)
    up, down = np.minimum(products.queries, 0), np.maximum(products.queries, 0)
    weightless = ~(products.queries != 0).any(axis=1)
    met = np.zeros((len(queries.ids), n), bool)
    own = queries.ids[:, None] == held.ids[None, :]
    scores = np.zeros((len(queries.ids), n), products.queries.dtype)
    scored = np.zeros(n, bool)
    active = np.arange(len(queries.ids))
    depth = 0
    while depth < n and len(active):
        until = min(depth + step, n)
        if step * dim > n - met[active].sum(axis=1).max():
            until = n  # the stride would read more entries than any query has vectors left
        step *= 4  # deeper walks are taken in longer strides
        fresh = np.zeros((len(active), n), bool)
        if until == n:
            fresh[:] = True
        else:
            for d in range(dim):
                falling = np.flatnonzero(products.queries[active, d] > 0)
                rising = np.flatnonzero(products.queries[active, d] < 0)
                fresh[np.ix_(falling, held.lists[n - until : n - depth, d])] = True
                fresh[np.ix_(rising, held.lists[depth:until, d])] = True
            fresh[weightless[active]] = True  # every score is zero, every vector a candidate
        fresh &= ~met[active]
        met[active] |= fresh
        fresh &= ~own[active]
        columns = np.flatnonzero(fresh.any(axis=0) & ~scored)
        if len(columns):
            scores[np.ix_(active, columns)] = products.of(active, columns)
            # a column scored for all queries still walking need not be scored again
            scored[columns] = True
        least = best.kth(products.least)
        good = fresh & (scores[active] >= least[active, None])
        row, column = contenders(good, scores[active], best.k)
        best.add(active[row], held.ids[column], scores[active[row], column])
        depth = until
        bound = down @ values[n - depth] + up @ values[depth - 1]
        active = active[~(best.kth(products.least)[active] > bound[active])]
    return int(met.sum())


def exact_top_k(
    rows: DataFrame,
    is_query: Column | str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    block: int = 8192,
    query_block: int = 256,
    step: int = 64,
    round_bytes: int = 1 << 23,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all other rows for each query.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id. The work grows
    with queries times vectors; the vectors are read once a round of ``round_bytes`` of
    queries and are never shuffled, ``query_block`` queries are walked at a time.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    held = scratch.stage(pack(vectors, block, sort_lists=True), "blocks")
    condition = F.expr(is_query) if isinstance(is_query, str) else is_query
    asked = scratch.stage(pack(vectors.where(condition).distinct(), block), "queries")
    first = 0
    for number, part in enumerate(rounds(asked, round_bytes)):
        chunks = joined_by_dim(part, query_block)
        numbers = first + np.concatenate(([0], np.cumsum([len(c.ids) for c in chunks])))
        first = int(numbers[-1])

        def search(frames: Iterator[pa.RecordBatch], chunks=chunks, numbers=numbers) -> Iterator[pa.RecordBatch]:
            best = [Best(c, k) for c in chunks]
            for frame in frames:
                for row in range(frame.num_rows):
                    block_held = Block.read(frame.slice(row, 1).to_pylist()[0])
                    for chunk, found in zip(chunks, best):
                        if chunk.dim == block_held.dim:
                            threshold_walk(chunk, block_held, found, step)
            for chunk, found, no in zip(chunks, best, numbers):
                if len(found.row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(chunk.ids[found.row]), pa.array(no + found.row), pa.array(found.ids),
                            pa.array(longs(found.scores)), pa.array([str(int(s)) for s in found.scores]),
                        ],
                        names=["query_id", "query_no", "vec_id", "score", "exact"],
                    )

        _merged(held.mapInArrow(search, FOUND), k).write.mode("append").parquet(scratch.path("found"))
    if not first:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    scratch.drop("blocks", "queries")
    return spark.read.parquet(scratch.path("found"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_no").orderBy(F.expr("CAST(exact AS DECIMAL(38,0))").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
