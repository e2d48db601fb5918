"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of its own label. Each positive asks for the best
rows of other labels whose score lies in a window that ends at a limit set by the
positive's score, so an anchor has several overlapping windows.

1. The distinct upper limits of an anchor, descending, cut the scores into disjoint slots:
   slot s holds scores above limit s + 1 and at most limit s; the last one goes down to
   the lowest lower limit.
2. A task streams its blocks of vectors, scores a chunk of anchors in one product and keeps
   the ``k`` best of every (anchor, slot) so far: a combiner that bounds what is shuffled by
   anchors, slots and tasks, whatever the number of negatives. A second combiner per
   (anchor, slot) merges the tasks.
3. The best rows at or below limit s are the merge of slots s, s + 1, …: each window is
   answered from the suffix that starts at its slot, then cut at its lower limit.

Rows with a null id or label, or a vector that is null, empty or holds null or non-finite
components, take no part. Repeated rows are separate rows; an anchor is never its own
positive, and each distinct (id, label, vector) of an anchor asks for itself. Only
vectors of equal length meet. Components beyond 2**53 count as 2**53, scores beyond 64 bits as
the ends of their range. A positive whose window is empty or holds no row gives no
rows (negative scores have empty windows). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch
from tamperlens.llm.vector_blocks import (
    Block, Products, best_of_groups, contenders, integer_vectors, joined_by_dim, longs, pack, rounds,
)

SCORED = "anchor_no bigint, anchor_id bigint, slot int, row_id bigint, score bigint"
MINED = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)


class Kept:
    """The k best rows of every (anchor, slot) of a chunk so far."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.group = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0)

    def add(self, anchor: np.ndarray, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        group = np.concatenate((self.group, anchor * self.slots + slot))
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        top = best_of_groups(group, scores, ids, self.k)
        self.group, self.ids, self.scores = group[top], ids[top], scores[top]

    def kth(self, anchors: int) -> np.ndarray:
        """Score of the k-th best of every (anchor, slot); endless below where fewer are known."""
        out = np.full(anchors * self.slots, -np.inf, self.scores.dtype)
        counts = np.bincount(self.group, minlength=len(out))
        out[counts == self.k] = self.scores[(np.cumsum(counts) - 1)[counts == self.k]]
        return out.reshape(anchors, self.slots)


def slot_limits(positive_scores: list[int], low: int, high: int) -> tuple[list[int], int]:
    """(descending distinct upper limits, lowest lower limit) of integer scores."""
    uppers = sorted({high * s // 100 for s in positive_scores}, reverse=True)
    return uppers, min(-(-low * s // 100) for s in positive_scores)


def _within_range(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores
    return np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1)


def _positives(anchors: Block, held: Block, kept: Kept) -> None:
    products = Products(anchors, held)
    same = (anchors.labels[:, None] == held.labels) & (anchors.ids[:, None] != held.ids)
    scores = _within_range(products.of(slice(None), slice(None)))
    anchor, row = contenders(same, scores, kept.k)
    kept.add(anchor, np.zeros(len(anchor), np.int64), held.ids[row], scores[anchor, row])


def _negatives(anchors: Block, limits: list[tuple[list[int], int]], held: Block, kept: Kept) -> None:
    asking = np.flatnonzero([bool(u) for u, _ in limits])
    if not len(asking):
        return
    products = Products(anchors, held)
    scores = _within_range(products.of(asking, slice(None)))
    highest = np.array([limits[a][0][0] for a in asking], scores.dtype)
    lowest = np.array([limits[a][1] for a in asking], scores.dtype)
    inside = (scores <= highest[:, None]) & (scores >= lowest[:, None])
    inside &= anchors.labels[asking][:, None] != held.labels
    anchor, row = np.nonzero(inside)
    score = scores[anchor, row]
    slot = np.zeros(len(anchor), np.int64)
    for s in range(1, kept.slots):
        limit = np.array([limits[a][0][s] if s < len(limits[a][0]) else limits[a][1] - 1 for a in asking], scores.dtype)
        slot += score <= limit[anchor]
    anchor = asking[anchor]
    # a score below its slot's k-th best of earlier blocks cannot win
    may = score >= kept.kth(len(limits))[anchor, slot]
    kept.add(anchor[may], slot[may], held.ids[row[may]], score[may])


def _stream(chunks: list[Block], numbers: np.ndarray, k: int, slots: int, judge):
    """A function for mapInArrow: ``judge(chunk number, block, kept)`` over all blocks of a task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Kept(slots, k) for _ in chunks]
        for frame in frames:
            for at in range(frame.num_rows):
                block = Block.read(frame.slice(at, 1).to_pylist()[0])
                for c, chunk in enumerate(chunks):
                    if chunk.dim == block.dim:
                        # a slice of the block bounds the candidates held at a time
                        for a in range(0, len(block.ids), 2048):
                            part = Block(block.ids[a : a + 2048], block.labels[a : a + 2048], block.v[a : a + 2048])
                            judge(c, part, kept[c])
        for chunk, found, no in zip(chunks, kept, numbers):
            if len(found.group):
                anchor, slot = found.group // slots, found.group % slots
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(no + anchor), pa.array(chunk.ids[anchor]), pa.array(slot.astype(np.int32)),
                        pa.array(found.ids), pa.array(longs(found.scores)),
                    ],
                    names=["anchor_no", "anchor_id", "slot", "row_id", "score"],
                )

    return run


def _best_per_slot(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_no", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column | str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    block: int = 8192,
    anchor_block: int = 256,
    round_bytes: int = 1 << 22,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``. For each anchor and each of its
    ``positives`` best rows of the same label: the ``k`` best rows of other labels with
    ``low * positive <= 100 * negative <= high * positive``. Scores are inner products of
    floor(scale * x); ties go to the smaller id. The label may be of any type that casts to
    text. The vectors are read twice a round of ``round_bytes`` of anchors, never shuffled.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    # labels only need comparing: equal texts have equal numbers
    names = rows.selectExpr(f"CAST({quoted(label_col)} AS STRING) AS name").where("name IS NOT NULL").distinct()
    labelled = _numbered(scratch, rows, names, label_col, id_col, vector_col, scale)
    held = scratch.stage(pack(labelled, block), "blocks")
    condition = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    asked = scratch.stage(pack(labelled.where(condition).distinct(), block), "anchors")
    first = 0
    for number, part in enumerate(rounds(asked, round_bytes)):
        chunks = joined_by_dim(part, anchor_block)
        numbers = first + np.concatenate(([0], np.cumsum([len(c.ids) for c in chunks])))
        first = int(numbers[-1])

        def same_label(c, part, kept, chunks=chunks):
            _positives(chunks[c], part, kept)

        best = _best_per_slot(held.mapInArrow(_stream(chunks, numbers, positives, 1, same_label), SCORED), positives)
        friends = scratch.stage(
            best.selectExpr("anchor_no", "anchor_id", "place", "row_id AS positive_id", "score AS positive_score"),
            f"positives-{number}",
        )
        # at most ``positives`` numbers for each anchor of the round, whose size is bounded
        known: dict[int, list[int]] = {}
        for row in friends.select("anchor_no", "positive_score").toLocalIterator():
            known.setdefault(row[0], []).append(row[1])
        limits = [
            [slot_limits(known[no + a], low, high) if no + a in known else ([], 0) for a in range(len(chunk.ids))]
            for chunk, no in zip(chunks, numbers.tolist())
        ]

        def other_labels(c, part, kept, chunks=chunks, limits=limits):
            _negatives(chunks[c], limits[c], part, kept)

        run = _stream(chunks, numbers, k, positives, other_labels)
        slots = _best_per_slot(held.mapInArrow(run, SCORED), k).selectExpr(
            "anchor_no", "slot", "row_id AS negative_id", "score AS negative_score"
        )
        ranked_limits = friends.selectExpr(
            "*",
            f"CAST(dense_rank() OVER (PARTITION BY anchor_no ORDER BY floor({high} * CAST(positive_score AS DECIMAL(24,0)) "
            "/ 100) DESC) - 1 AS INT) AS own_slot",
        )
        # the suffix of slots from a window's own slot on holds all it can see
        window = Window.partitionBy("anchor_no", "place").orderBy(F.desc("negative_score"), "negative_id")
        mined = (
            ranked_limits.join(slots, "anchor_no")
            .where("slot >= own_slot")
            .withColumn("rank", F.row_number().over(window))
            .where(
                f"rank <= {k} AND CAST({low} * CAST(positive_score AS DECIMAL(24,0)) AS DECIMAL(38,0)) <= "
                "100 * CAST(negative_score AS DECIMAL(24,0))"
            )
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        )
        mined.write.mode("append").parquet(scratch.path("mined"))
        scratch.drop(f"positives-{number}")
    if not first:
        return spark.createDataFrame([], MINED)
    scratch.drop("blocks", "anchors")
    return spark.read.schema(MINED).parquet(scratch.path("mined"))


def _numbered(
    scratch: Scratch, rows: DataFrame, names: DataFrame, label_col: str, id_col: str, vector_col: str, scale: int
) -> DataFrame:
    """(vec_id, label, v) with labels as 64-bit numbers that are equal exactly if the labels are."""
    label = quoted(label_col)
    kind = dict(rows.dtypes).get(label_col, "string")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return integer_vectors(rows.where(f"{label} IS NOT NULL"), id_col, vector_col, scale, f"CAST({label} AS BIGINT)")
    numbers = scratch.stage(names.withColumn("number", F.monotonically_increasing_id()), "labels")
    named = rows.selectExpr(
        f"{quoted(id_col)} AS vec_id", f"{quoted(vector_col)} AS raw", f"CAST({label} AS STRING) AS name"
    ).join(numbers, "name")
    return integer_vectors(named, "vec_id", "raw", scale, "number")
