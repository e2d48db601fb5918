from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from llm.brute import PATTERNS, base_spans, brute_jaccard, smallest_reachable
from tamperlens.llm.jaccard_forest import Forest, jaccard_join, one_of_each_group
from tamperlens.llm.licenses import scan_licenses
from tamperlens.llm.pii import digest_columns, find_personal_data, redact

def check_spans(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert set(want) <= set(r.spans.split(",") if r.spans else [])
        kinds = Counter(s.split(":")[0] for s in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in PATTERNS]


def test_base_spans_of_random_texts(spark):
    random.seed(5)
    signs = [*"ab.@.@-_%123450  +()é", "4111 1111 1111 1111", "+1 (017) 555-7713", "1.2.3.4"]
    texts = {i: "".join(random.choice(signs) for _ in range(random.randint(0, 60))) for i in range(1500)}
    texts[5000] = "a@b.c_d@e.f.g 1.1.1.1.1.1.1.1 999.1.1.1 0001.2.3.4"
    texts[5001] = "1.1.1.1 " * 700 + "é" + "a@b.co " * 700
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check_spans(digest_columns(find_personal_data(df)).collect(), texts)


def test_base_spans_of_the_table(documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    check_spans(digest_columns(find_personal_data(documents)).collect(), texts)


def test_added_spans_and_redaction(spark, odd_documents, no_documents):
    rows = [(i, f'call token = "{i:032x}" now, or 4111 1111 1111 1111 and a.b@c.de') for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = digest_columns(find_personal_data(df)).collect()
    assert all(r.n_card == 1 and r.n_email == 1 for r in got)
    assert sum("secret:" in r.spans for r in got) > 20
    assert all("<CARD>" in r.text and "<EMAIL>" in r.text and "4111" not in r.text for r in redact(df).collect())
    out = redact(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    untouched = odd_documents.where("doc_id < 9 OR doc_id IS NULL")
    assert redact(untouched).exceptAll(untouched).count() == 0
    assert find_personal_data(odd_documents).count() == odd_documents.count()
    assert redact(no_documents).count() == find_personal_data(no_documents).count() == 0


def test_odd_licenses(spark, odd_documents, no_documents):
    rows = scan_licenses(odd_documents).collect()
    assert len(rows) == odd_documents.count() and scan_licenses(no_documents).count() == 0
    assert {r.doc_id: r.n_words for r in rows}[7] == 60_000
    texts = [
        (1, "CC-BY cc by. All rights, reserved! Gnu General PUBLIC license"),
        (2, "cc x by all rights not reserved"),
        (3, "Licensed under the new Apache License, Version 2.0"),
        (3, "Licensed under the new Apache License, Version 2.0"),
        (4, "éall rights reserved"),
    ]
    by = {}
    for r in scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect():
        by.setdefault(r.doc_id, []).append(r)
    first = by[1][0]
    assert (first.n_words, first.n_base, first.first_word, first.last_word) == (11, 4, 0, 8)
    assert first.base_labels == "cc-by,gpl,reserved" and first.score == 1.0
    assert by[2][0].n_base == 0 and by[2][0].first_word is None and by[2][0].base_labels == ""
    assert [r.labels for r in by[3]] == ["apache-2.0"] * 2 and 0.6 <= by[3][0].score < 1
    assert by[4][0].n_base == 0


@pytest.mark.parametrize("per_block", [256, 7])
def test_jaccard_join_against_brute_force(spark, per_block):
    random.seed(9)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(4000)]
    texts, number = {}, 0
    for group in range(60):
        base = random.choices(words, k=random.randint(3, 90))
        for _ in range(random.choice([1, 2, 5, 40 if group == 7 else 3])):
            changed = list(base)
            for _ in range(random.randint(0, 2)):
                changed[random.randrange(len(changed))] = random.choice(words)
            texts[number] = " ".join(changed)
            number += 1
    near = brute_jaccard(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in jaccard_join(df, per_block=per_block).collect()}
    least = smallest_reachable(near)
    real = sum(map(len, near.values()))
    found = sum(r.n_links for r in got.values())
    assert found <= real and found >= 0.99 * real
    same = [i for i in got if got[i].group_id == least[i] and got[i].kept == (least[i] == i)]
    assert len(same) >= 0.97 * len(got)


def test_jaccard_join_of_the_table_keeps_one_of_each_group(documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    near = brute_jaccard(texts)
    joined = jaccard_join(documents)
    got = {r.doc_id: r for r in joined.collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(n) for i, n in near.items()}
    least = smallest_reachable(near)
    stays = {r.doc_id for r in one_of_each_group(documents, joined).select("doc_id").collect()}
    assert stays == set(least.values())


def test_odd_documents_in_the_join(odd_documents, no_documents):
    joined = jaccard_join(odd_documents)
    got = [(r.doc_id, r.n_links, r.group_id, r.kept) for r in joined.collect()]
    assert len(got) == odd_documents.count()
    assert got.count((1, 1, 1, True)) == 2 and (2, 1, 1, False) in got
    assert all((i, 0, i, True) in got for i in (3, 4, 5, 6, 7, 8)) and (None, None, None, True) in got
    kept = one_of_each_group(odd_documents, joined)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, None]))
    assert jaccard_join(no_documents).count() == 0
    assert one_of_each_group(no_documents, jaccard_join(no_documents)).count() == 0


def test_easy_copies_hide_no_pair_at_the_threshold(spark):
    """Many pairs at 0.95 lift the estimated recall; lone pairs at 0.8 must be found all the same."""
    rng = random.Random(4)
    rows, hard = [], []
    for n in range(1500):
        shared, more = (40, 10) if n < 300 else (95, 5)  # shingles of the first text, and what the second adds
        words = [f"w{rng.randrange(10**9)}" for _ in range(shared + more + 4)]
        rows += [(2 * n, " ".join(words[: shared + 4])), (2 * n + 1, " ".join(words))]
        hard += [2 * n] if n < 300 else []
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join(docs).collect()}
    assert sum(got[i] for i in hard) >= 0.995 * len(hard)
    assert Forest().reaching(0.8, 0.995).deepest == 6
    for threshold in (0.5, 0.65, 0.9):
        forest = Forest().reaching(threshold, 0.995)
        assert forest.chance(threshold, forest.deepest) >= 0.995


def test_texts_of_repeated_ids_are_compared(spark):
    a = "one two three four five six seven eight nine ten"
    b = "red green blue white black brown pink grey gold plum"
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, b.upper() + "!", "z"), (5, a, "q"), (5, "something else entirely here now", "q"),
            (6, None, "n"), (6, "", "n"), (6, "", "n"), (1, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shingle_set string")
    joined = jaccard_join(docs)
    got = sorted((r.doc_id, r.class_id, r.n_links, r.group_id, r.kept) for r in joined.collect())
    assert got == sorted([
        (1, 1, 1, 1, True), (1, 1, 1, 1, True), (1, 1, 2, 1, True), (2, 1, 2, 1, False), (3, 1, 2, 1, False),
        (5, 1, 1, 1, False), (5, 5, 0, 5, True), (6, 6, 0, 6, True), (6, 6, 0, 6, True), (6, 6, 0, 6, True),
    ])
    stays = sorted((r.doc_id, r.text or "", r.shingle_set) for r in one_of_each_group(docs, joined).collect())
    assert stays == sorted([(1, a, "x"), (1, b, "y"), (5, "something else entirely here now", "q"), (6, "", "n")])


def test_near_texts_of_one_id_leave_one(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(7, " ".join(words)), (7, " ".join([*words, "more"])), (8, " ".join(words[1:]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    joined = jaccard_join(docs)
    assert sorted((r.n_links, r.group_id) for r in joined.collect()) == [(2, 7)] * 3
    assert [r.doc_id for r in one_of_each_group(docs, joined).collect()] == [7]
