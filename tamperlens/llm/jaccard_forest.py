"""N-gram Jaccard join: MinHash LSH forest, adaptive prefixes, exact verification.

1. One pass over the texts gives each document a digest of its distinct word shingles
   and, for each tree of the forest, the trie nodes on the path of its signature.
2. Documents with equal shingle sets form a class; only its representative goes on.
3. Candidates share a trie node. Matching starts at the longest prefix at which a pair
   right at the threshold is found with the target's chance, whatever else the table
   holds. How often matched documents meet over the trees tells the chance that such a
   pair was found at all; while the estimated recall is below the target, the prefix is
   shortened further.
4. Candidates joined by shared nodes form a neighbourhood. Its documents are read once
   more, and every pair inside is compared exactly. Large neighbourhoods are cut into
   blocks, and pairs of blocks are separate units of work, so no task holds a group;
   a unit returns counts and a spanning forest, never its pairs.

Null ids, and texts without words, link with nothing. A text of fewer words than a
shingle has its whole word row as its only shingle. A document is an id with a shingle set:
different texts of one id are compared like any others, equal ones count once. Every input
row gets its result row. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch, block_pairs, bounded_batches, components, parts_for, unit_rows
from tamperlens.llm.textcells import batches, mix, shingles, words_of
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import Limits

SKETCH = "id bigint, n bigint, set_a bigint, set_b bigint, nodes array<bigint>"
SETS = "id bigint, n bigint, set_a bigint, set_b bigint, hashes binary"
DIGEST = ["n", "set_a", "set_b"]
#: classes of this many rows are broadcast instead of shuffled; at most 100,000 can be
HOT = Limits(hot_rows=1000)
FOUND = "id bigint, links bigint, other bigint"
#: shingles of a document up to which it counts as one when blocks are measured
SHINGLES_EACH = 8192


class Forest:
    """Shape of the LSH forest: ``trees`` tries over prefixes of up to ``deepest`` hashes."""

    def __init__(self, trees: int = 20, deepest: int = 8, shallowest: int = 5, seed: int = 11):
        self.trees, self.deepest, self.shallowest, self.seed = trees, deepest, shallowest, seed
        rng = np.random.default_rng(seed)
        n = trees * deepest
        self.factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    @property
    def depths(self) -> list[int]:
        return list(range(self.deepest, self.shallowest - 1, -1))

    def chance(self, likeness: float, depth: int) -> float:
        """The chance that a pair of this similarity shares a node at this depth."""
        return 1 - (1 - likeness**depth) ** self.trees

    def reaching(self, threshold: float, target: float) -> Forest:
        """This forest with only depths that find a pair at the threshold with the target's chance."""
        deepest = self.deepest
        while deepest > 1 and self.chance(threshold, deepest) < target:
            deepest -= 1
        return Forest(self.trees, deepest, min(self.shallowest, deepest), self.seed)

    def nodes(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Trie nodes of each set: one row per set, trees x depths ids from the deepest."""
        out = np.empty((len(starts), self.trees, len(self.depths)), np.uint64)
        for tree in range(self.trees):
            path = np.full(len(starts), tree + 1, np.uint64)
            for level in range(self.deepest):
                i = tree * self.deepest + level
                least = np.minimum.reduceat(hashes * self.factor[i] + self.shift[i], starts)
                path = mix(path * np.uint64(0x9E3779B97F4A7C15) + (least >> np.uint64(20)))
                depth = level + 1
                if depth >= self.shallowest:
                    out[:, tree, self.deepest - depth] = path
        return out.reshape(len(starts), -1)


def _text_sets(ids: pa.Array, texts, k):
    """(ids, places with words, starts, hashes) for each manageable part of a batch."""
    for begin, end in batches(texts):
        docs, hashes = shingles(words_of(texts[begin:end]), k)
        present, starts = np.unique(docs, return_index=True)
        yield ids.slice(begin, end - begin), present, starts, hashes


def _digests(starts: np.ndarray, hashes: np.ndarray) -> list[pa.Array]:
    """(n, set_a, set_b) of shingle sets: their size and two sums of their hashes."""
    if not len(starts):
        return [pa.array([], pa.int64())] * 3
    return [
        pa.array(np.diff(np.append(starts, len(hashes))), pa.int64()),
        pa.array(np.add.reduceat(mix(hashes), starts).view(np.int64)),
        pa.array(np.add.reduceat(mix(~hashes), starts).view(np.int64)),
    ]


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, forest: Forest) -> DataFrame:
    """Set digest and trie nodes of every row; n is 0 for those without an id or words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *DIGEST, "nodes"]
        for frame in frames:
            for ids, present, starts, hashes in _text_sets(frame.column(0), frame.column(1).to_pylist(), k):
                if len(present):
                    nodes = forest.nodes(hashes, starts)
                    listed = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(starts) + 1) * nodes.shape[1], pa.int32()),
                        pa.array(nodes.reshape(-1).view(np.int64)),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(present)), *_digests(starts, hashes), listed], names=names
                    )
                absent = np.setdiff1d(np.arange(len(ids)), present)
                if len(absent):
                    none = pa.nulls(len(absent), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(absent)), pa.array(np.zeros(len(absent), np.int64)), none, none,
                            pa.nulls(len(absent), pa.list_(pa.int64())),
                        ],
                        names=names,
                    )

    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(f"CAST({quoted(id_col)} AS BIGINT) AS id", f"CAST({quoted(text_col)} AS STRING) AS text")
    return rows.selectExpr("id", "if(id IS NULL, NULL, text) AS text").mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """Whole sorted shingle sets of the given (id, text) rows as binary, with their digests."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for ids, present, starts, hashes in _text_sets(frame.column(0), frame.column(1).to_pylist(), k):
                sets = np.split(hashes, starts[1:]) if len(starts) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(present, pa.int64())), *_digests(starts, hashes),
                        pa.array([x.tobytes() for x in sets], pa.binary()),
                    ],
                    names=["id", *DIGEST, "hashes"],
                )

    return docs.mapInArrow(run, SETS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(
        f"CAST({quoted(id_col)} AS BIGINT) AS id", f"CAST({quoted(text_col)} AS STRING) AS text"
    ).where("id IS NOT NULL AND text IS NOT NULL")


def _dense_shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a unit by a blocked 0/1 matrix product."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = met > 1  # a shingle of one document adds to no intersection
    number = np.cumsum(common) - 1
    use = common[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    width = max(256, (1 << 23) // max(len(sets), 1))
    for left in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, (left, left + width))
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[a:b], column[a:b] - left] = 1
        shared += grid @ grid.T  # counts stay far below 2**24 in each block
    return shared


def compare_unit(own: np.ndarray, sets: list[np.ndarray], split: bool, threshold: float):
    """Links inside one unit: a boolean matrix, only across blocks if ``split``."""
    shared = _dense_shared(sets)
    size = np.array([len(s) for s in sets], np.float64)
    linked = shared / (size[:, None] + size[None, :] - shared) >= threshold
    np.fill_diagonal(linked, False)
    if split:
        linked &= own[:, None] != own[None, :]
    return linked


def forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a small link matrix."""
    seen = np.zeros(len(linked), bool)
    edges = []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            node = front.pop()
            fresh = np.flatnonzero(linked[node] & ~seen)
            seen[fresh] = True
            front.extend(fresh.tolist())
            edges.extend((node, int(x)) for x in fresh)
    return edges


def verify_units(threshold: float):
    """Exact comparison of whole units; one group holds many small ones or one large one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, links, others = [], [], []
        for (_, i, j), unit in rows.groupby(["hood", "block_i", "block_j"], sort=False):
            if len(unit) < 2:
                continue
            unit = unit.sort_values("id")
            sets = [np.frombuffer(h, np.uint64) for h in unit["hashes"]]
            linked = compare_unit(unit["block"].to_numpy(), sets, i != j, threshold)
            weight = linked.astype(np.float64) @ unit["copies"].to_numpy(np.float64)
            doc = unit["id"].to_numpy()
            for at in np.flatnonzero(weight):
                ids.append(doc[at]), links.append(int(weight[at])), others.append(doc[at])
            for a, b in forest_edges(linked):
                ids.append(doc[a]), links.append(0), others.append(doc[b])
        return pd.DataFrame(
            {
                "id": np.array(ids, np.int64),
                "links": np.array(links, np.int64),
                "other": np.array(others, np.int64),
            }
        )

    return run


def candidate_edges(
    scratch: Scratch, nodes: DataFrame, forest: Forest, threshold: float, target: float
) -> tuple[DataFrame, dict[int, float]]:
    """Star edges (a, b) over shared trie nodes at the longest prefix of ``forest`` that meets the target.

    ``nodes`` has (id, nodes). Each node's documents are tied to its smallest one; the
    number of trees in which a tie repeats estimates the pair's similarity, and with it
    the chance that it is found at this prefix (a truncated Horvitz-Thompson ratio). The
    estimate is a mean over the table, so ``forest`` must reach the target at its deepest.
    """
    levels, recall = len(forest.depths), {}
    for at, depth in enumerate(forest.depths):
        paths = nodes.selectExpr(
            "id", f"explode(transform(sequence(0, {forest.trees - 1}), t -> nodes[t * {levels} + {at}])) AS node"
        )
        met = paths.groupBy("node").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
        ties = (
            paths.join(met.select("node", "head"), "node")
            .where("id <> head")
            .groupBy("id", "head")
            .agg(F.count("*").alias("trees"))
        )
        edges = scratch.stage(ties, f"ties-{depth}")
        seen = edges.selectExpr(f"power(least(trees, {forest.trees} - 0.5) / {forest.trees}, 1.0 / {depth}) AS likeness")
        row = (
            seen.where(F.col("likeness") >= threshold * 0.97)
            .selectExpr(
                "count(*) AS found",
                f"sum(1 / (1 - power(1 - power(greatest(likeness, {threshold}), {depth}), {forest.trees}))) AS real",
            )
            .first()
        )
        recall[depth] = 1.0 if not row.found else row.found / row.real
        if recall[depth] >= target or depth == forest.shallowest:
            return edges.selectExpr("id AS a", "head AS b"), recall
        scratch.drop(f"ties-{depth}")
    raise AssertionError("unreachable")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.995,
    forest: Forest | None = None,
    per_block: int = 256,
) -> DataFrame:
    """Rows (id_col, class_id, n_links, group_id, kept, shingle_set), one for each input row.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` the number of
    other documents with Jaccard similarity >= ``threshold`` (copies included),
    ``group_id`` the smallest id reachable by links, ``kept`` whether the row is of that id
    and, where several of its texts are in the group, of the one with the least digest.
    ``shingle_set`` is the digest of the row's set, null without words. A null id keeps
    null results and is kept.
    """
    forest = (forest or Forest()).reaching(threshold, target_recall)
    scratch = Scratch(docs.sparkSession, "jaccard")
    raw = scratch.stage(sketches(docs, id_col, text_col, k, forest), "sketches")
    one = raw.where("n > 0").groupBy("id", *DIGEST).agg(F.min("nodes").alias("nodes"), F.count("*").alias("rows"))
    classes = (
        one.groupBy(*DIGEST)
        .agg(F.min(F.struct("id", "nodes")).alias("r"), F.count("*").alias("copies"), F.sum("rows").alias("rows"))
        .selectExpr(*DIGEST, "r.id AS class_id", "copies", "rows", "r.nodes AS nodes")
    )
    # classes are told apart by a number of their own: texts of one id may be in several
    reps = scratch.stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    edges, _ = candidate_edges(scratch, reps.selectExpr("node AS id", "nodes"), forest, threshold, target_recall)
    hoods = scratch.stage(
        components(scratch, edges, "hoods").selectExpr("node AS id", "component AS hood"), "hoods"
    )
    asked = scratch.stage(
        reps.join(hoods, reps["node"] == hoods["id"]).selectExpr("class_id", *DIGEST, "node", "copies"), "asked"
    )
    texts = _keyed(docs, id_col, text_col).join(asked.selectExpr("class_id AS id").distinct(), "id", "left_semi")
    sets = scratch.stage(
        shingle_sets(texts, k)
        .groupBy("id", *DIGEST)
        .agg(F.min("hashes").alias("hashes"))
        .join(asked.withColumnRenamed("class_id", "id"), ["id", *DIGEST])
        .selectExpr("node AS id", "n", "hashes", "copies"),
        "sets",
    )
    members = hoods.join(sets, "id")
    # a block is bounded by its documents and by their shingles
    sizes = scratch.stage(
        hoods.join(sets.selectExpr("id", "n AS shingles"), "id")
        .groupBy("hood")
        .agg(F.expr(f"greatest(count(*), sum(shingles) DIV {SHINGLES_EACH}) AS n")),
        "sizes",
    )
    units = block_pairs(members.drop("n"), sizes, "hood", "id", per_block)
    rows = unit_rows(sizes, per_block)
    found = scratch.stage(
        units.drop("n")
        .withColumn("task", F.expr(f"pmod(xxhash64(hood, block_i, block_j), {parts_for(rows, 512, 8)})"))
        .groupBy("task")
        .applyInPandas(verify_units(threshold), FOUND),
        "found",
    )
    scratch.drop("hoods", "asked", "sets", "sizes")
    groups = components(scratch, found.selectExpr("id AS a", "other AS b"), "groups").join(
        reps.select("node", "class_id", *DIGEST), "node"
    )
    head = F.min(F.struct(F.col("class_id"), F.struct(*DIGEST).alias("digest"))).alias("head")
    heads = groups.groupBy("component").agg(head)
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    by_class = scratch.stage(
        reps.select("node", *DIGEST, "class_id", "copies", "rows")
        .join(links, "node", "left")
        .join(groups.select("node", "component").join(heads, "component"), "node", "left")
        .selectExpr(
            *DIGEST, "rows", "class_id", "copies - 1 + coalesce(links, 0) AS n_links",
            "coalesce(head.class_id, class_id) AS group_id",
            "coalesce(head.digest = struct(n, set_a, set_b), true) AS heads",
        ),
        "by-class",
    )
    key = quoted(id_col)
    with_words = attach_by_key(raw.where("n > 0").select("id", *DIGEST), by_class, DIGEST, "rows", HOT).selectExpr(
        f"id AS {key}", "class_id", "n_links", "group_id", "group_id = id AND heads AS kept",
        "struct(n, set_a, set_b) AS shingle_set",
    )
    without = raw.where("n = 0").selectExpr(
        f"id AS {key}", "id AS class_id", "if(id IS NULL, NULL, 0L) AS n_links", "id AS group_id", "true AS kept",
        "CAST(NULL AS STRUCT<n: BIGINT, set_a: BIGINT, set_b: BIGINT>) AS shingle_set",
    )
    return with_words.unionByName(without)


def one_of_each_group(
    docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5
) -> DataFrame:
    """Documents that stay: the one that heads its group, and all without an id or words.

    Of the rows of an id that repeats those stay whose text heads a group, one of each
    shingle set, and one of each text without words. ``k`` is that of the join.
    """
    key, text = quoted(id_col), f"CAST({quoted(text_col)} AS STRING)"
    named = joined.where(f"{key} IS NOT NULL").withColumnRenamed(id_col, "_kept")
    per_id = named.groupBy("_kept").agg(F.count("*").alias("_n"), F.count_if("kept").alias("_k")).where("_k > 0")
    nameless = docs.where(F.col(key).isNull())
    single = docs.join(per_id.where("_n = 1"), F.expr(f"{key} = _kept"), "left_semi")
    repeated = docs.join(per_id.where("_n > 1"), F.expr(f"{key} = _kept"), "left_semi")
    # few texts: those of ids that stand in several rows
    own = repeated.selectExpr(f"CAST({key} AS BIGINT) AS id", f"coalesce({text}, '') AS text").distinct()
    digests = _text_digests(own, k)
    heads = named.where("kept").selectExpr("_kept AS id", "shingle_set").distinct()
    stays = (
        digests.join(heads.withColumnRenamed("id", "_id"), F.expr("id = _id AND shingle_set <=> digest"))
        .selectExpr("id AS _id", "text AS _text", "digest", "if(digest IS NULL, text, '') AS _alone")
    )
    rows = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    ones = (
        repeated.select(rows.alias("_row"), F.expr(f"{key} AS _key"), F.expr(f"coalesce({text}, '') AS _own"))
        .join(stays, F.expr("_key = _id AND _own = _text"))
        .groupBy("_id", "digest", "_alone")
        .agg(F.min_by("_row", "_own").alias("_row"))
        .select("_row.*")
    )
    return single.unionByName(ones).unionByName(nameless)


def _text_digests(texts: DataFrame, k: int) -> DataFrame:
    """(id, text, digest) of (id, text) rows; the digest is null without words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = 0
            for ids, present, starts, hashes in _text_sets(frame.column(0), frame.column(1).to_pylist(), k):
                place = np.full(len(ids), -1)
                place[present] = np.arange(len(present))
                index = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, frame.column(1).slice(at, len(ids)), *[d.take(index) for d in _digests(starts, hashes)]],
                    names=["id", "text", *DIGEST],
                )
                at += len(ids)

    found = texts.mapInArrow(run, "id bigint, text string, n bigint, set_a bigint, set_b bigint")
    return found.selectExpr("id", "text", "if(n IS NULL, NULL, struct(n, set_a, set_b)) AS digest")
