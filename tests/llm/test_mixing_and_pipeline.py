from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from llm.brute import base_spans, brute_jaccard, smallest_reachable
from tamperlens.llm import mixing
from tamperlens.llm.common import components, Scratch
from tamperlens.llm.mixing import mix_sources, route, take, water_fill
from tamperlens.llm.queries import op8_source_mixing, vocabulary
from tamperlens.llm.tokens import PieceEncoder


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**share, **capped}
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets():
    assert water_fill([10, 100, 50], [5, 2, 1], 3) == pytest.approx([30, 260 / 3, 130 / 3])
    assert water_fill([], [], 3) == [] and water_fill([0, 0], [5, 2], 3) == [0, 0]


def test_flow_meets_quotas_and_repeats_least():
    # the shared pattern serves the source that has no other text
    flows = route([100, 50, 40], [[0, 1], [1], [2]], [80, 60, 100], 3)
    assert [sum(f.get(s, 0) for f in flows) for s in range(3)] == pytest.approx([80, 60, 100])
    assert sum(flows[0].values()) <= 100 + 1e-6 and sum(flows[1].values()) <= 50 + 1e-6
    short = route([10], [[0]], [100], 3)
    assert short[0][0] == pytest.approx(30)


def test_mix_of_the_table(spark, documents, sf_dir):
    rows = op8_source_mixing(spark, sf_dir).collect()
    text = {r.doc_id: r for r in documents.collect()}
    assert len(rows) == len(text)
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r.size
        sizes[text[r.doc_id].source] += r.size
        taken[text[r.doc_id].source] += r.taken
    targets = brute_targets(sizes)
    for r in rows:
        source = text[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] for s in sizes)
    again = {r.doc_id: r.taken for r in op8_source_mixing(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_narrowed_ranges_meet_the_rest(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 16)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rows = [(i, "ab"[i % 3 == 0], 1 + i * 7919 % 50) for i in range(3000)] + [(9999, "a", 20)] * 500
    df = spark.createDataFrame(rows, "id bigint, source string, n int")
    got = mix_sources(df, "n", "array(source)").collect()
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.n * r.mix.times for r in own) - own[0].mix.target) <= 25
        assert len({r.mix.times for r in own}) <= 2


def test_overlapping_sources_and_odd_rows(spark):
    rows = [(1, ["a", "b"], 10, 1)] * 4 + [(2, ["b"], 10, 1), (3, [None], 5, 2), (4, ["b", "b"], 0, 3), (5, ["c"], 7, None)]
    df = spark.createDataFrame(rows, "id bigint, s array<string>, n int, mix int").withColumnRenamed("mix", "size")
    got = mix_sources(df, "n", "s").collect()
    assert len(got) == len(rows) and all(0 <= r.mix.times <= 3 for r in got)
    repeated = take(mix_sources(df, "n", "s"))
    assert repeated.columns == df.columns
    assert repeated.count() == sum(r.mix.times for r in got)
    assert mix_sources(df.where("false"), "n", "s").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(6, 60)] + [(59, 3)]
    pairs = chain + star + [(900, 901), (901, 900), (77, 77)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.component for r in components(Scratch(spark, "test"), df, "c").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 3 for i in [3, *range(5, 60)])
    assert got[900] == got[901] == 900 and 77 not in got


def test_pipeline_stages_against_brute_force(spark, documents, sf_dir):
    """Every stage judged on its own input; the texts of the mix come back out of the packing."""
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near duplicates", "personal data", "source mix", "packing"
    ]
    scratch, docs, inputs = Scratch(spark, "test"), documents, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        if number < 4:
            assert docs.columns == documents.columns
        docs = scratch.stage(stage(spark, docs, sf_dir), f"{number}")
    toxic = {r.doc_id for r in inputs[0]} - {r.doc_id for r in inputs[1]}
    insults = "idiot moron scum trash clown loser stupid worthless disgusting pathetic".split()
    holds = {r.doc_id for r in inputs[0] if any(w in re.findall(r"\w+", r.text.lower()) for w in insults)}
    assert len(holds & toxic) >= 0.9 * len(holds)
    near = brute_jaccard({r.doc_id: r.text for r in inputs[1]})
    assert {r.doc_id for r in inputs[2]} == set(smallest_reachable(near).values())
    assert {r.doc_id for r in inputs[3]} == {r.doc_id for r in inputs[2]}
    assert not any(base_spans(r.text) for r in inputs[3])
    assert all(r.n_chars == len(r.text) for r in inputs[3])
    untouched = {r.doc_id: r.text for r in inputs[2] if not base_spans(r.text) and "token =" not in r.text}
    assert all(r.text == untouched[r.doc_id] for r in inputs[3] if r.doc_id in untouched)
    sizes, taken = Counter(), Counter()
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    for r in inputs[3]:
        sizes[r.source] += count(r.text)
    for r in inputs[4]:
        taken[r.source] += count(r.text)
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] for s in sizes)
    encoder = PieceEncoder(vocabulary())
    want = Counter()
    for r in inputs[4]:
        want[r.doc_id, tuple([*encoder.encode([r.text])[0].tolist(), 1])] += 1
    pieces = {}
    for p in docs.collect():
        pieces.setdefault(p.doc_id, []).append(p)
    for doc, parts in pieces.items():
        parts.sort(key=lambda p: (p.sequence_id, p.offset))
        ids = [i for p in parts for i in np.frombuffer(p.ids, "<u4").tolist()]
        copies = sum(n for (d, _), n in want.items() if d == doc)
        assert Counter(ids) == Counter(i for (d, t), n in want.items() if d == doc for i in t * n)
        assert sum(p.start == 0 for p in parts) == copies
    assert set(pieces) == {d for d, _ in want}


def test_pipeline_of_odd_documents(spark, odd_documents, no_documents, sf_dir):
    for docs in (odd_documents, no_documents):
        scratch = Scratch(spark, "test")
        columns = docs.columns
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = scratch.stage(stage(spark, docs, sf_dir), f"{number}")
            assert number == 4 or docs.columns == columns
    assert docs.count() == 0
