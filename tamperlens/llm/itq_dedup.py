"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank.

1. A rotation is learned on a bounded sample (``fit_rows``) by iterative quantisation, so
   that the signs of the rotated, centred vectors are balanced binary codes of ``bits``.
2. Every distinct vector is indexed: its code is cut into ``tables`` substrings, and each
   substring is entered once for each of its bits left out. Two codes share an entry of a
   table exactly if their substrings differ in at most one bit, which holds for every pair
   of codes at most 2 * tables - 1 bits apart, and for most pairs further apart.
3. Vectors of one entry are compared with their original components. A pair is judged in
   the first table and entry it shares only, so nothing is counted twice. Large entries
   are cut into blocks; pairs of blocks are separate units, and a unit returns counts and
   a spanning forest, never its pairs.

Equal vectors of one label form a class that is indexed once. Vectors that are null, zero
or hold null or non-finite components, and null labels, link with nothing. Vectors of
different lengths never link. Rows with a null id keep null results and are kept; repeated
rows of an id with one vector count as one vector each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch, block_pairs, components, parts_for, unit_rows

CODED = "rep bigint, lab string, dim int, copies bigint, v binary, code bigint"
FOUND = "rep bigint, links bigint, other bigint"
BITS = 64
#: rotations are learned for this many most frequent lengths, each from at most so many bytes of vectors
LEARNED_LENGTHS, SAMPLE_BYTES = 64, 1 << 26
#: of fewer vectors the mean and rotation would only tell these apart
LEAST_SAMPLE = 256


def learn_rotation(sample: np.ndarray, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, map) of iterative quantisation: codes are signs of (x - mean) @ map.

    Dimensions beyond ``BITS`` are left to the principal ones; fewer are spread over all
    bits by a random orthonormal frame before the rotation is learned.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    basis = vectors[:, ::-1][:, :BITS]
    if basis.shape[1] < BITS:
        frame, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
        basis = basis @ frame[: basis.shape[1]]
    projected = centred @ basis
    rotation, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
    for _ in range(rounds):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        rotation = (left @ right).T
    return mean, basis @ rotation


def plain_map(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, map) for a length without a sample: random directions, always the same for a length."""
    return np.zeros(dim), np.random.default_rng(dim).standard_normal((dim, BITS))


def codes_of(vectors: np.ndarray, mean: np.ndarray, mapping: np.ndarray) -> np.ndarray:
    positive = (vectors - mean) @ mapping >= 0
    return np.packbits(positive, axis=1, bitorder="little").view(np.uint64).ravel()


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, lab, raw): rows that may link, unit vectors in double precision."""
    return (
        rows.selectExpr(
            f"CAST({quoted(id_col)} AS BIGINT) AS vec_id",
            f"CAST({quoted(label_col)} AS STRING) AS lab",
            f"CAST({quoted(vector_col)} AS ARRAY<DOUBLE>) AS raw",
        )
        .where(
            "vec_id IS NOT NULL AND lab IS NOT NULL AND raw IS NOT NULL AND "
            "forall(raw, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND "
            "exists(raw, x -> x <> 0)"
        )
    )


def first_shared(a: np.ndarray, b: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """First (table, left-out bit) in which two codes share an entry; -1 if in none."""
    width = BITS // tables
    difference = a ^ b
    table = np.full(len(a), -1, np.int64)
    bit = np.zeros(len(a), np.int64)
    for t in range(tables - 1, -1, -1):
        part = (difference >> np.uint64(t * width)) & np.uint64((1 << width) - 1)
        near = (part & (part - np.uint64(1))) == 0  # no bit or one bit differs
        near |= part == 0
        table[near] = t
        one = np.maximum(part[near], np.uint64(1)).astype(np.float64)
        bit[near] = np.log2(one).astype(np.int64)
    return table, bit


def _cosines(vectors: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Cosines of pairs of vectors, whose units may differ in length, some thousand at a time."""
    out = np.zeros(len(i))
    for size in np.unique(sizes[i]):
        same = np.flatnonzero(sizes[i] == size)
        for begin in range(0, len(same), at_once):
            part = same[begin : begin + at_once]
            a, c = np.stack([vectors[x] for x in i[part]]), np.stack([vectors[x] for x in j[part]])
            dot = np.einsum("ij,ij->i", a, c)
            out[part] = dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", c, c))
    return out


def compare_rows(rows: pd.DataFrame, tables: int, threshold: float) -> pd.DataFrame:
    """Judge all pairs of every unit in ``rows``; pairs live only inside this call."""
    rows = rows.sort_values(["entry", "block_i", "block_j", "rep"], ignore_index=True)
    unit = rows.groupby(["entry", "block_i", "block_j"], sort=False).ngroup().to_numpy()
    reps, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
    codes = rows["code"].to_numpy().view(np.uint64)
    table, bit = rows["tab"].to_numpy(), rows["bit"].to_numpy()
    block, across = rows["block"].to_numpy(), (rows["block_i"] != rows["block_j"]).to_numpy()
    vectors = [np.frombuffer(v, np.float64) for v in rows["v"]]
    sizes = np.array([len(v) for v in vectors], np.int64)
    begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    stops = np.append(begin[1:], len(unit))
    widest = int((stops - begin).max()) if len(begin) else 0
    head = {int(s): s for s in begin}
    lefts, rights = [], []
    for gap in range(1, widest):
        i = np.flatnonzero(unit[:-gap] == unit[gap:])
        j = i + gap
        use = ~across[i] | (block[i] != block[j])
        i, j = i[use], j[use]
        t, b = first_shared(codes[i], codes[j], tables)
        use = (t == table[i]) & (b == bit[i])
        i, j = i[use], j[use]
        if not len(i):
            continue
        near = _cosines(vectors, sizes, i, j) >= threshold
        lefts.append(i[near])
        rights.append(j[near])
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else left
    weight = np.zeros(len(rows), np.int64)
    np.add.at(weight, left, copies[right])
    np.add.at(weight, right, copies[left])
    linked = np.flatnonzero(weight)
    parent = np.arange(len(rows))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for i, j in zip(left.tolist(), right.tolist()):
        p, q = root(i), root(j)
        if p != q:
            parent[q] = p
            tree.append((reps[i], reps[j]))
    ids = np.concatenate((reps[linked], np.array([x for x, _ in tree], np.int64)))
    links = np.concatenate((weight[linked], np.zeros(len(tree), np.int64)))
    others = np.concatenate((reps[linked], np.array([y for _, y in tree], np.int64)))
    return pd.DataFrame({"rep": ids, "links": links, "other": others}).astype("int64")


def link_near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = 4,
    fit_rows: int = 20_000,
    per_block: int = 512,
) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each input row.

    ``fit_rows`` bounds the sample the rotation is learned on (the smallest hashes of all
    ids); every vector is indexed. Recall against brute force is measured in the tests.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "itq")
    clean = clean_vectors(rows, id_col, vector_col, label_col)
    classes = scratch.stage(
        clean.groupBy("lab", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    models = {}
    counted = classes.groupBy(F.size("raw").alias("d")).agg(F.count("*").alias("n"))
    for dim, _ in counted.where(f"n >= {LEAST_SAMPLE}").orderBy(F.desc("n"), "d").limit(LEARNED_LENGTHS).collect():
        rows_of = max(2, min(fit_rows, SAMPLE_BYTES // (8 * dim)))
        sample = classes.where(F.size("raw") == dim).select("raw").orderBy(F.xxhash64("rep", "lab")).limit(rows_of)
        flat = sample.toArrow().column("raw").combine_chunks().flatten()
        units = np.asarray(flat, np.float64).reshape(-1, dim)
        units = units / np.abs(units).max(axis=1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        models[dim] = learn_rotation(units)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            raw = frame.column(2)
            sizes = np.asarray(pa.compute.list_value_length(raw))
            flat, ends = np.asarray(raw.flatten()), np.cumsum(sizes)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                vectors = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                part = frame.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array(np.full(len(mine), dim), pa.int32()), part.column(3),
                        pa.array([v.tobytes() for v in vectors], pa.binary()),
                        pa.array(codes_of(vectors, *(models.get(int(dim)) or plain_map(int(dim)))).view(np.int64)),
                    ],
                    names=["rep", "lab", "dim", "copies", "v", "code"],
                )

    coded = scratch.stage(
        classes.select("rep", "lab", "raw", "copies").mapInArrow(encode, CODED), "codes"
    )
    width = BITS // tables
    mask = (1 << width) - 1
    entries = (
        coded.selectExpr("rep", "lab", "dim", "code", f"explode(sequence(0, {tables - 1})) AS tab")
        .withColumn("part", F.expr(f"shiftrightunsigned(code, tab * {width}) & {mask}L"))
        .withColumn("bit", F.expr(f"explode(sequence(0, {width - 1}))"))
        .selectExpr(
            "rep", "lab", "tab", "bit",
            "xxhash64(lab, dim, tab, bit, part & ~shiftleft(1L, bit)) AS entry",
        )
    )
    sizes = scratch.stage(entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    placed = block_pairs(entries, sizes, "entry", "rep", per_block).drop("n")
    full = placed.join(coded.select("rep", "lab", "copies", "v", "code"), ["rep", "lab"])
    tasks = parts_for(unit_rows(sizes, per_block), 8192, 8)
    found = scratch.stage(
        full.withColumn("task", F.expr(f"pmod(xxhash64(entry, block_i, block_j), {tasks})"))
        .groupBy("task")
        .applyInPandas(lambda unit: compare_rows(unit, tables, threshold), FOUND),
        "found",
    )
    groups = components(scratch, found.selectExpr("rep AS a", "other AS b"), "groups")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(links, "rep", "left")
        .join(groups.selectExpr("node AS rep", "component"), "rep", "left")
        .selectExpr(
            "lab", "raw", "copies - 1 + coalesce(links, 0) AS n_links",
            "coalesce(component, rep) AS component_id",
        )
    )
    per_row = clean.join(by_class, ["lab", "raw"]).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    ids = rows.selectExpr(f"CAST({quoted(id_col)} AS BIGINT) AS vec_id")
    return ids.join(per_row, "vec_id", "left").selectExpr(
        f"vec_id AS {quoted(id_col)}",
        "CASE WHEN vec_id IS NOT NULL THEN coalesce(n_links, 0) END AS n_links",
        "coalesce(component_id, vec_id) AS component_id",
        "coalesce(component_id = vec_id, true) AS kept",
    )
