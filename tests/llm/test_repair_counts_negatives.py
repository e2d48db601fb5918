"""Conversation repair, the digest cache and hard negatives against plain versions."""

from __future__ import annotations

import binascii
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tamperlens.llm.common import Scratch
from tamperlens.llm.conversation_repair import apply_repairs, damaged, repair_conversations
from tamperlens.llm.hard_negatives import mine_hard_negatives, slot_limits
from tamperlens.llm.queries import vocabulary
from tamperlens.llm.token_counts import count_tokens, stored_counts, version_digest

TURNS = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\v\f\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        out += [] if harm == 0 else [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def faults_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        if not text.strip(BLANKS):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if text.rstrip(BLANKS)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def every_repair(rows, faults):
    """All edit sequences with at most two inserts in a row: (cost, audit, repaired rows)."""
    fills = [f for n in range(3) for f in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, cost, audit, kept):
        initials = "".join(r[:1] or "?" for r, _ in kept)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        for fill in fills:
            more = kept + [(r, "") for r in fill]
            paid, spelt = cost + 2 * len(fill), audit + "I" * len(fill)
            if i == len(rows):
                if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in more)):
                    yield paid, spelt, more
                continue
            role, text = rows[i][2:]
            yield from go(i + 1, paid + 3, spelt + "D", more)
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                yield from go(i + 1, paid + extra, spelt + "K", more + [(role, text)])
                for other in ("user", "assistant"):
                    yield from go(i + 1, paid + extra + 2, spelt + "R", more + [(other, text)])

    return go(0, 0, "", [])


def brute_summary(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults = faults_of(rows)
    cost, audit, repaired = min(every_repair(rows, faults), key=lambda x: x[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    ), repaired


def small_conversations():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", None, "", "tool", "User", "agent"]
    texts = ["Yes.", "Yes.", "no", " ", None, "Why?\n", "ünfertig", "a.b", "", "Ok!  "]
    rows = [
        (conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts))
        for conv in [None, *range(160)]
        for _ in range(rng.randrange(1, 5))
    ]
    return rows + [(500, None, None, None), (500, None, None, None)]


def test_repairs_are_the_cheapest_of_all(spark):
    rows = small_conversations()
    df = spark.createDataFrame([r + ("x",) for r in rows], TURNS + ", copy string").repartition(5)
    hurt = damaged(df)
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(hurt, present="present").collect()}
    assert set(got) == {r[0] for r in rows}
    kept = brute_damage(rows)
    stays = {}
    for conv in got:
        want, stays[conv] = brute_summary([r for r in kept if r[0] == conv])
        assert got[conv] == want, conv
    repairs = repair_conversations(hurt, present="present")
    applied = apply_repairs(hurt, repairs, present="present").collect()
    for conv in got:
        mine = sorted((r for r in applied if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [(r.role, r.text) for r in mine] == stays[conv]


def test_long_and_empty_conversations(spark):
    # 3,000 rows in one conversation: a dynamic program over tops written apart
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), f"row {t}" + rng.choice([".", ""])) for t in range(3000)]
    got = repair_conversations(spark.createDataFrame(rows, TURNS)).first()
    best = {"": (0, ""), "s": None, "u": None, "t": None}
    reach = {"": ["", "u", "t"], "s": ["s", "u", "t"], "u": ["u", "t", "u"], "t": ["t", "u", "t"]}
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("t", "u"): "u", ("u", "a"): "t"}
    for _, _, role, text in rows:
        cut = not text.endswith(".")
        offers = {}
        for top, known in best.items():
            for n, at in enumerate(reach[top]) if known else []:
                steps = [(at, "D", 3)] + [(move.get((at, role[0])), "K", cut)] + [(move.get((at, x)), "R", 2 + cut) for x in "ua"]
                for to, letter, price in steps:
                    if to is not None:
                        offers.setdefault(to, []).append((known[0] + 2 * n + price, known[1] + "I" * n + letter))
        best = {top: min(offers[top]) if top in offers else None for top in best}
    ends = [(k[0] + 2 * n, k[1] + "I" * n) for top, k in best.items() if k for n, at in enumerate(reach[top]) if at in ("", "t")]
    assert (got.cost, got.audit) == min(ends)
    assert repair_conversations(spark.createDataFrame([], TURNS)).count() == 0
    nothing = damaged(spark.createDataFrame([(c, t, "user", "a.") for c in range(40) for t in range(1)], TURNS))
    gone = [r for r in repair_conversations(nothing, present="present").collect() if binascii.crc32(f"{r.conv_id}:0".encode()) % 20 == 0]
    assert gone and all(tuple(r)[1:7] == (0,) * 6 and r.audit == "" and r.repaired_sha256 == hashlib.sha256().hexdigest() for r in gone)


@pytest.fixture(scope="module")
def counter():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    return lambda text: len(model.encode(text or ""))


def test_counts_equal_the_library(spark, odd_documents, documents, counter):
    folder = Scratch(spark, "counts-test").path("cache")
    path = vocabulary("piece_bpe_32k.model")
    odd = odd_documents.unionByName(
        spark.createDataFrame([(70, "</s> <s> <unk>  a\tb\nあ é ﬁ", "x")], "doc_id bigint, text string, _key string"),
        allowMissingColumns=True,
    )
    for table in (odd, documents.select("doc_id", "text")):
        rows = table.collect()
        got = sorted(map(tuple, count_tokens(table, folder, path).collect()), key=repr)
        want = [(r.doc_id, len((r.text or "").encode()), counter(r.text)) for r in rows]
        assert got == sorted(want, key=repr)
    assert count_tokens(odd.where("false"), folder, path).count() == 0


def test_cache_is_used_and_grows_by_misses_only(spark, counter):
    folder = Scratch(spark, "counts-test").path("cache")
    path = vocabulary("piece_bpe_32k.model")
    version = f"{folder}/version={version_digest(path, chr(99) + 'oalesce({text}, ' + chr(39) * 2 + ')')}"
    first = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None), (4, "")], "doc_id int, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(first, folder, path).collect()} == {
        1: counter("one text"), 2: counter("one text"), 3: 0, 4: 0,
    }
    assert spark.read.parquet(version).count() == 2  # each distinct content once
    # a planted count shows that hits are not encoded again
    spark.createDataFrame([(hashlib.sha256(b"planted").digest(), 777)], "digest binary, n_tokens bigint").write.mode(
        "append"
    ).parquet(version)
    more = spark.createDataFrame([(5, "planted"), (6, "one text"), (7, "another")], "doc_id int, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(more, folder, path).collect()} == {
        5: 777, 6: counter("one text"), 7: counter("another"),
    }
    assert spark.read.parquet(version).count() == 4
    assert stored_counts(spark, version).count() == 4
    # another tokenizer has counts of its own
    other = count_tokens(more, folder, vocabulary("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in other}[5] != 777


def test_known_texts_are_not_shuffled(spark):
    """With few misses the semi join is a broadcast below the aggregate that shuffles texts."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat(CAST(id AS STRING), 50) AS text")
    folder = Scratch(spark, "counts-test").path("misses")
    spark.createDataFrame([(b"x",)], "digest binary").write.parquet(folder)
    misses = spark.read.parquet(folder)
    contents = docs.selectExpr("text", "unhex(sha2(text, 256)) AS digest").groupBy("digest").agg({"text": "min"})
    plan = contents.join(misses, "digest", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


VECTORS = "vec_id bigint, embedding array<float>, label int, score double, slot string"


def brute_negatives(rows, is_anchor):
    good = [
        (i, np.floor(256 * np.array(v, float)).astype(int), lab)
        for i, v, lab, *_ in rows
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for a, v, lab in good:
        if not is_anchor(a):
            continue
        scored = sorted((-int(v @ w), j, other) for j, w, other in good if j != a and len(w) == len(v))
        for ps, p, _ in [x for x in scored if x[2] == lab][:5]:
            window = [x for x in scored if x[2] != lab and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:5]
            out |= {(a, p, r + 1, j, -ps, -ns) for r, (ns, j, _) in enumerate(window)}
    return out


@pytest.mark.parametrize("block, anchor_block, round_bytes", [(8192, 256, 1 << 22), (29, 3, 2000)])
def test_negatives_equal_brute_force(spark, block, anchor_block, round_bytes):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((4, 8))
    rows = []
    for i in range(400):
        near = centres[i % 4] + rng.standard_normal(8) * rng.choice([0.1, 0.5, 1.5])
        rows.append((i, [float(np.float32(x)) for x in near], int(rng.integers(0, 3)), 0.0, "s"))
    rows += [(i, rows[3][1], i % 2, 0.0, None) for i in range(500, 520)]  # ties
    rows += [(600, None, 1, 1.0, "s"), (700, [float("nan")] * 8, 1, 1.0, "s"), (800, rows[0][1], None, 1.0, "s")]
    rows += [(900, [1.0, None] + [0.0] * 6, 1, 1.0, "s"), (None, rows[0][1], 1, 1.0, "s"), (1000, [], 1, 1.0, "s")]
    rows += [(1100, [1.0, 2.0], 0, 0.0, "s"), (1101, [1.0, 2.0], 0, 0.0, "s"), (1102, [1.0, 1.9], 1, 0.0, "s")]
    rows += [(1200, [0.0] * 8, 1, 0.0, "s")]  # all scores zero
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    got = mine_hard_negatives(
        df, "vec_id % 20 = 0", block=block, anchor_block=anchor_block, round_bytes=round_bytes
    ).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_of_text_labels_and_huge_vectors(spark):
    big = 3.0e14  # products leave 64 bits: ranked all the same
    rows = [(0, [big, 1.0], "a"), (1, [big, 2.0], "a"), (2, [big * 0.9, 1.0], "b"), (3, [big * 0.5, 1.0], "b"), (4, [big * 0.95, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")
    got = mine_hard_negatives(df, "vec_id = 0").collect()
    # scores are cut to the range of a 64-bit integer, so all meet at its end and ids decide
    assert [(r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got][:1] == [(0, 1, 1, 2)]
    assert [r.negative_id for r in got] == [2, 3] and {r.negative_score for r in got} == {2**63 - 1}
    small = spark.createDataFrame([(i, v, lab) for (i, _, lab), v in zip(rows, ([1.0, 0.0], [1.0, 0.0], [0.9, 0.0], [0.5, 0.0], [1.0, 0.0]))], df.schema)
    assert [(r.negative_id, r.positive_score, r.negative_score) for r in mine_hard_negatives(small, "vec_id = 0").collect()] == [
        (2, 65536, 58880)
    ]
    assert mine_hard_negatives(df.where("false"), "vec_id = 0").count() == 0


def test_slots():
    assert slot_limits([10, 7, 7, -3], 80, 100) == ([10, 7, -3], -2)
