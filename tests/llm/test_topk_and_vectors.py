from __future__ import annotations

import numpy as np
import pytest

from tamperlens.llm.itq_dedup import first_shared, learn_rotation, codes_of, link_near_duplicates
from tamperlens.llm.threshold_topk import Best, exact_top_k, threshold_walk
from tamperlens.llm.vector_blocks import Block

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, task int"


def brute_top(rows, k):
    vectors = {
        i: np.floor(256 * np.array(v, float)).astype(int)
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    }
    out = {}
    for q in vectors:
        if q % 50 == 0:
            scored = [(-int(v @ vectors[q]), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
            out.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])})
    return out


@pytest.mark.parametrize("block, query_block", [(8192, 1024), (37, 2)])
def test_top_k_equals_brute_force(spark, block, query_block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)], i % 3, 0.0, i) for i in range(260)]
    rows += [(i, rows[3][1], 0, 0.0, 0) for i in range(300, 320)]  # ties
    rows += [(400, None, 1, None, None), (450, [0.0] * 7 + [float("nan")], 1, None, None), (None, rows[0][1], 1, 1.0, 1)]
    rows += [(500, [0.0] * 8, 1, None, None), (550, [1.0, None] * 4, 1, None, None), (551, [], 1, None, None)]
    rows += [(552, [1.0, 2.0], 1, None, None)]  # another length
    df = spark.createDataFrame(rows, VECTORS)
    got = exact_top_k(df, "vec_id % 50 = 0", block=block, query_block=query_block, step=4).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute_top(rows, 5)


def test_top_k_of_little(spark):
    few = spark.createDataFrame([(0, [1.0], 1, 0.0, 1), (1, [2.0], 1, 0.0, 1)], VECTORS)
    assert [tuple(r) for r in exact_top_k(few, "vec_id % 50 = 0").collect()] == [(0, 1, 1, 131072)]
    assert exact_top_k(few.where("false"), "vec_id % 50 = 0").count() == 0


def test_top_k_of_huge_and_repeated_queries(spark):
    """Products beyond 64 bits are ranked exactly; each vector of a query id asks for itself."""
    rows = [(0, [1e15, 1.0], 0, 0.0, 1), (1, [1e15, 2.0], 0, 0.0, 1), (2, [1e15, 3.0], 0, 0.0, 1), (3, [-1e15, 1.0], 0, 0.0, 1)]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    got = exact_top_k(df, "vec_id = 0").collect()
    assert [(r.rank, r.vec_id) for r in sorted(got)] == [(1, 2), (2, 1), (3, 3)]
    assert {r.vec_id: r.score for r in got}[2] == 2**63 - 1 and {r.vec_id: r.score for r in got}[3] == -(2**63)
    twice = [(0, [1.0, 0.0], 0, 0.0, 1), (0, [0.0, 1.0], 0, 0.0, 1), (1, [3.0, 1.0], 0, 0.0, 1), (2, [1.0, 3.0], 0, 0.0, 1)]
    got = exact_top_k(spark.createDataFrame(twice, VECTORS), "vec_id = 0", k=1).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 3 * 65536), (0, 1, 2, 3 * 65536)]


def test_top_k_over_many_rounds(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)], 0, 0.0, 1) for i in range(900)]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    got = exact_top_k(df, "vec_id % 50 = 0", block=50, query_block=4, step=2, round_bytes=200).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute_top(rows, 5)


def test_walks_stop_early():
    """In few dimensions the bound ends a walk after a small part of the lists."""
    rng = np.random.default_rng(3)
    v = rng.integers(-4000, 4000, (8192, 2))
    held = Block(np.arange(8192), np.zeros(8192, np.int64), v, np.argsort(v, axis=0, kind="stable"))
    queries = Block(np.arange(0, 8192, 512), np.zeros(16, np.int64), v[::512])
    best = Best(queries, 5)
    met = threshold_walk(queries, held, best, 16)
    assert met < 0.2 * 16 * 8192
    for q in range(16):
        scored = sorted((-int(v[i] @ queries.v[q]), i) for i in range(8192) if i != queries.ids[q])[:5]
        mine = best.row == q
        assert [(-int(s), int(i)) for s, i in zip(best.scores[mine], best.ids[mine])] == scored
    # a second block far from the first one's best ends at once
    low = Block(np.arange(9000, 9100), np.zeros(100, np.int64), np.ones((100, 2), np.int64), np.tile(np.arange(100)[:, None], 2))
    assert threshold_walk(queries, low, best, 1) <= 16 * 100 * 0.2


def test_entries_shared_by_codes():
    a = np.array([0, 0, 0], np.uint64)
    b = np.array([0, 1 << 5, 0x0003_0003_0003_0003], np.uint64)
    table, bit = first_shared(a, b, 4)
    assert table.tolist() == [0, 0, -1] and bit.tolist()[:2] == [0, 5]


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((2000, 24))
    codes = codes_of(vectors, *learn_rotation(vectors))
    ones = [float(((codes >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(64)]
    assert 0.4 < min(ones) and max(ones) < 0.6


def brute_links(rows, threshold=0.98):
    good = [
        (i, np.array(v, float), lab) for i, v, lab, *_ in rows
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    near = {i: set() for i, *_ in good}
    for n, (i, v, lab) in enumerate(good):
        for j, w, other in good[:n]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                near[i].add(j), near[j].add(i)
    return near


def test_links_against_brute_force(spark):
    """Recall of the index over near copies at all distances from the threshold."""
    rng = np.random.default_rng(2)
    rows, number = [], 0
    for _ in range(120):
        centre = rng.standard_normal(64)
        for _ in range(4):
            noisy = centre + rng.standard_normal(64) * rng.uniform(0.02, 0.16)
            rows.append((number, [float(np.float32(x)) for x in noisy], number % 2 if number % 9 else 0, 0.0, 1))
            number += 1
    base = rng.standard_normal(64)
    for _ in range(90):  # one large group, cut into blocks below
        rows.append((number, [float(np.float32(x)) for x in base + rng.standard_normal(64) * 0.03], 1, 0.0, 1))
        number += 1
    near = brute_links(rows)
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: r for r in link_near_duplicates(df, per_block=16).collect()}
    found, real = sum(r.n_links for r in got.values()), sum(map(len, near.values()))
    assert found <= real and found >= 0.95 * real
    group = [got[i] for i in range(480, 570)]
    assert all(r.n_links == len(near[r.vec_id]) for r in group)
    assert all(r.component_id == 480 and r.kept == (r.vec_id == 480) for r in group)


def test_odd_vectors(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [
        (1, v, 7, 0.0, 1), (2, v, 7, 0.0, 1), (3, [2.0, 4.0, 6.0], 7, 0.0, 1), (4, v, 8, 0.0, 1), (5, v, None, 0.0, 1),
        (6, None, 7, 0.0, 1), (7, [0.0] * 3, 7, 0.0, 1), (8, [1.0, None, 3.0], 7, 0.0, 1),
        (9, [1.0, float("inf"), 3.0], 7, None, 1), (10, w, 7, 0.0, 1), (None, v, 7, 0.0, 1), (11, [1.0, 2.0], 7, 0.0, 1),
    ]
    got = link_near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[3] == (2, 1, False)
    assert all(by[i] == (0, i, True) for i in range(4, 12))
    empty = spark.createDataFrame([], VECTORS)
    assert link_near_duplicates(empty).count() == 0


def test_vectors_of_many_lengths(spark):
    """A hundred lengths, most of them without a learned rotation."""
    rng = np.random.default_rng(5)
    rows = []
    for dim in range(1, 101):
        v = rng.standard_normal(dim)
        rows += [(10 * dim + i, [float(x) for x in v + (0 if i else 1e-3)], 1, 0.0, 1) for i in range(2)]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    got = {r.vec_id: r for r in link_near_duplicates(df).collect()}
    near = brute_links(rows)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, near.values()))
    assert all(got[i].n_links <= len(near[i]) for i in got if i in near)
