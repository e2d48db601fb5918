"""Ordering checks on planted tampering, against brute force, in both strategies."""

from __future__ import annotations

import random

import pytest
from conftest import by, same_rows
from pyspark.sql import functions as F

from tamperlens.operators.ordering import (
    dependent_var_effects,
    duplicate_id_rows,
    duplicate_ids,
    duplicate_ids_across_groups,
    escalate_severity,
    filter_order_anomalies,
    out_of_sequence_ids,
    previous_ids,
    sorting_anomalies,
)
from tamperlens.plans.limits import Limits

SCHEMA = "row_id bigint, pid bigint, grp string, score double"


def experiment(spark, moved=True):
    """Three groups of 60 rows with rising ids; eight rows of one group moved ahead."""
    ids = []
    for g, name in enumerate("abc"):
        block = [(1000 * g + i, name) for i in range(60)]
        if moved and name == "b":
            block = block[40:48] + block[:40] + block[48:]
        ids += block
    rows = [(r, pid, grp, 50.0 + (r * 37 % 11)) for r, (pid, grp) in enumerate(ids)]
    if moved:
        r, _, grp, score = rows[170]
        rows[170] = (r, 5, grp, score)  # id 5 of group a appears in group c as well
    return spark.createDataFrame(rows, SCHEMA)


def test_clean_table_gives_nothing(spark):
    df = experiment(spark, moved=False)
    assert out_of_sequence_ids(df, "pid", "grp").isEmpty()
    assert duplicate_ids_across_groups(df, "pid", "grp").isEmpty()
    assert duplicate_ids(df, "pid").isEmpty()
    assert sorting_anomalies(df, "pid", "grp").isEmpty()


def test_moved_rows_are_found(spark):
    found = by(out_of_sequence_ids(experiment(spark), "pid", "grp").collect(), "row_index")
    # the eight rows stand 40 places early, the forty they passed 8 places late
    moved = {r: f for r, f in found.items() if f["position_difference"] == 40}
    assert sorted(moved) == list(range(60, 68))
    assert len([f for f in found.values() if f["position_difference"] == 8]) == 40
    first = found[60]
    assert first["severity"] == 9
    assert first["actual_position"] == 0 and first["expected_position"] == 40
    assert first["previous_id"] == "59"
    assert first["condition_values"] == {"grp": "b"}
    assert first["description"] == "1040 stands 40 places off its sorted place"
    assert [tuple(s) for s in first["surrounding_ids"]] == [(0, "1040"), (1, "1041"), (2, "1042")]


def test_duplicate_across_groups(spark):
    found = by(duplicate_ids_across_groups(experiment(spark), "pid", "grp").collect(), "row_index")
    assert sorted(found) == [5, 170]
    assert found[170]["id_value"] == found[5]["id_value"]
    assert found[170]["duplicate_count"] == 2 and found[170]["different_conditions"] == 2
    assert found[5]["previous_id"] == "4" and found[170]["severity"] == 9


def test_duplicates_inside_one_group_are_not_cross_group(spark):
    df = spark.createDataFrame([(0, 1, "a", 0.0), (1, 1, "a", 0.0), (2, 2, None, 0.0), (3, 2, "b", 0.0)], SCHEMA)
    found = duplicate_ids_across_groups(df, "pid", "grp").collect()
    assert {f["id_value"] for f in found} == {"2"}  # a missing group is a group value here


def test_duplicate_lists_and_long_form(spark):
    rows = [(i, 7 if i % 3 == 0 else i, "g", 0.0) for i in range(30)] + [(30, 1, "g", 0.0), (31, None, "g", 0.0), (32, None, "g", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = by(duplicate_ids(df, "pid").collect(), "id_value")
    assert sorted(found) == ["1", "7"]
    assert found["1"]["rows"] == [1, 30] and found["1"]["count"] == 2
    assert found["7"]["rows"] == sorted([*range(0, 30, 3), 7])
    parts = [r for r in duplicate_ids(df, "pid", per_part=5).collect() if r["id_value"] == "7"]
    assert all(len(r["rows"]) <= 5 and r["count"] == 11 for r in parts) and len({r["part"] for r in parts}) == len(parts)
    assert sorted(i for r in parts for i in r["rows"]) == found["7"]["rows"]
    long = duplicate_id_rows(df, "pid").collect()
    assert sorted(r["row_index"] for r in long if r["id_value"] == "7") == found["7"]["rows"]


def test_hot_id_takes_the_spread_plan_with_equal_rows(spark, tiny):
    rows = [(i, 7 if i % 3 == 0 else i // 2, "ab"[i % 2], 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    for check in (duplicate_ids, duplicate_id_rows):
        assert same_rows(check(df, "pid"), check(df, "pid", limits=tiny))
    assert same_rows(
        duplicate_ids_across_groups(df, "pid", "grp"),
        duplicate_ids_across_groups(df, "pid", "grp", limits=tiny),
    )


def brute_force(rows, numeric):
    """Positions and expected positions straight from the definition."""
    groups = {}
    for r, pid, grp, _ in rows:
        if grp is not None:
            groups.setdefault(grp, []).append((r, pid))
    found = set()
    for members in groups.values():
        ids = [pid for _, pid in members]
        known = sorted(pid for pid in ids if pid is not None)
        last = {pid: i for i, pid in enumerate(known)}
        if not numeric and ids == known + [None] * (len(ids) - len(known)):
            continue
        for at, (r, pid) in enumerate(members):
            if pid is not None and abs(at - last[pid]) >= (4 if numeric else 2):
                found.add((r, at, last[pid]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("numeric", [True, False])
def test_sequence_check_equals_brute_force(spark, tiny, seed, numeric):
    rng = random.Random(seed)
    rows = []
    for r in range(160):
        grp = None if rng.random() < 0.05 else rng.choice(["hot", "hot", "hot", "x", "y"])
        pid = None if rng.random() < 0.05 else rng.randrange(40)
        rows.append((r, pid if numeric or pid is None else f"id{pid:02d}", grp, 0.0))
    # one sorted group with ties: never flagged for string ids
    rows += [(160 + i, (i // 3 + 50) if numeric else f"z{i // 3}", "sorted", 0.0) for i in range(20)]
    kind = "bigint" if numeric else "string"
    df = spark.createDataFrame(rows, f"row_id bigint, pid {kind}, grp string, score double")
    plain = out_of_sequence_ids(df, "pid", "grp", strategy="window")
    blocked = out_of_sequence_ids(df, "pid", "grp", strategy="auto", limits=tiny)
    got = {(f["row_index"], f["actual_position"], f["expected_position"]) for f in plain.collect()}
    assert got == brute_force(rows, numeric)
    assert same_rows(plain, blocked)


def _sorts(monkeypatch):
    """Names of the columns of every staged sort from here on."""
    from tamperlens.operators import ordering

    made, real = [], ordering.stage_sorted
    monkeypatch.setattr(ordering, "stage_sorted", lambda df, order: made.append(order) or real(df, order))
    return made


@pytest.mark.parametrize("lookup_rows", [0, 70, 500_000])
@pytest.mark.parametrize("broken", [(), ("a",), ("a", "b"), ("null",)])
def test_groups_in_order_are_not_sorted_again(spark, monkeypatch, lookup_rows, broken):
    """blocks of rising groups rank ids by position; only groups with a descent are sorted."""
    rows = []
    for r in range(240):
        grp, k = "ab"[r % 2], r // 2
        pid = k // 2 if k < 30 else 15 + (k - 30) // 7 if k < 60 else k // 2  # runs of two and of seven equal ids
        if (k == 83 and grp in broken) or (k == 20 and grp in broken):  # at a block end and inside
            pid = 3
        if k == 50 and "null" in broken:
            pid = None
        rows.append((r, pid, grp, 0.0))
    df = spark.createDataFrame(rows, SCHEMA)
    plain = out_of_sequence_ids(df, "pid", "grp", strategy="window")
    made = _sorts(monkeypatch)
    limits = Limits(window_rows=3, block_rows=24, hot_rows=4, lookup_rows=lookup_rows)
    blocked = out_of_sequence_ids(df, "pid", "grp", limits=limits)
    assert bool(made) == bool(broken)
    assert same_rows(plain, blocked)
    found = {(f["row_index"], f["actual_position"], f["expected_position"]) for f in blocked.collect()}
    assert found == brute_force(rows, True) and found


def test_ties_flag_themselves_from_five_equal_ids(spark):
    rows = [(i, 1, "a", 0.0) for i in range(5)]
    found = out_of_sequence_ids(spark.createDataFrame(rows, SCHEMA), "pid", "grp").collect()
    assert [(f["row_index"], f["expected_position"]) for f in found] == [(0, 4)]
    assert found[0]["previous_id"] is None


def test_string_ids(spark):
    rows = [(i, f"p{n}", "a", 0.0) for i, n in enumerate([3, 1, 2, 4, 5])]
    df = spark.createDataFrame(rows, "row_id bigint, pid string, grp string, score double")
    found = out_of_sequence_ids(df, "pid", "grp").collect()
    assert [(f["id_value"], f["severity"], f["previous_id"]) for f in found] == [("p3", 7, None)]
    assert found[0]["description"] == "p3 stands off its sorted place"


def shifted(n, by_places):
    """A group of n rising ids whose first id moved ``by_places`` back."""
    ids = list(range(n))
    ids.insert(by_places, ids.pop(0))
    return ids


def test_cluster_filter(spark, tiny):
    groups = {
        "drop": [4, 1, 2, 3, 0, 5, 6, 7],  # two findings of four places each
        "keep_far": shifted(12, 7),  # one finding of seven places
        "cluster": list(range(5, 10)) + list(range(5)),  # ten findings of five places
    }
    rows, r = [], 0
    for name, ids in groups.items():
        for i in ids:
            rows.append((r, i, name, 0.0))
            r += 1
    found = out_of_sequence_ids(spark.createDataFrame(rows, SCHEMA), "pid", "grp")
    kept = filter_order_anomalies(found)
    names = [f["group_label"] for f in kept.collect()]
    assert names.count("grp=drop") == 0
    assert names.count("grp=keep_far") == 1
    assert names.count("grp=cluster") == 10
    one = [f for f in kept.collect() if f["group_label"] == "grp=cluster"][0]
    assert one["cluster_size"] == 10 and one["severity"] == 9
    assert one["description"].endswith(", one of 10 in grp=cluster")
    assert same_rows(kept, filter_order_anomalies(found, tiny))


def test_effects_and_escalation(spark):
    rows = [(i, i, "a", 100.0 if i < 4 else float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    effects = dependent_var_effects(df, [0, 1, 2, 3], ["score"])
    one = effects.collect()[0]
    assert one["direction"] == "higher" and one["anomalous_mean"] == 100.0 and one["anomalous_std"] == 0.0
    strings = df.selectExpr("row_id", "concat('p', 9 - row_id) AS pid", "grp", "score").filter("row_id < 10")
    found = out_of_sequence_ids(strings, "pid", "grp")
    raised = escalate_severity(found, effects, ["score"]).collect()
    assert {f["severity"] for f in raised} == {8}
    assert all(f["dependent_var_effects"][0]["column"] == "score" for f in raised)


def test_effects_need_two_rows_on_each_side(spark):
    df = experiment(spark)
    assert dependent_var_effects(df, [3], ["score"]).isEmpty()


def test_sorting_anomalies_ranked(spark, tiny):
    df = experiment(spark)
    found = sorting_anomalies(df, "pid", "grp").collect()
    keys = [(-f["severity"], f["row_index"]) for f in found]
    assert keys == sorted(keys)
    assert {f["type"] for f in found} == {"duplicate_id", "out_of_sequence_id"}
    spread = sorting_anomalies(df, "pid", "grp", strategy="auto", limits=tiny)
    assert same_rows(sorting_anomalies(df, "pid", "grp"), spread)


def test_anomalies_are_sorted_without_their_texts(spark):
    """F8: texts are made from ids and groups after the sort, so it does not move them."""
    found = sorting_anomalies(experiment(spark), "pid", "grp")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("stands in") < text.index("Sort [")


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_anomalies_of_missing_groups_and_ids_in_all_plans(spark, tiny, kind):
    """F8: previous ids come from the file, over block ends, missing groups and missing ids."""
    rng = random.Random(7)
    rows = [
        (r, rng.choice([None, *range(12)]) if r % 4 else r // 9, rng.choice([None, "a", "b", "b"]), float(r % 3))
        for r in range(150)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pid", F.col("pid").cast(kind))
    plain = sorting_anomalies(df, "pid", "grp")
    assert same_rows(plain, sorting_anomalies(df, "pid", "grp", limits=tiny))
    assert same_rows(plain, sorting_anomalies(df, "pid", "grp", limits=Limits(window_rows=3, block_rows=7)))
    ids = [pid for _, pid, _, _ in rows]
    groups = {}
    for _, pid, grp, _ in rows:
        groups.setdefault(pid, []).append(grp)
    want = {
        (r, None if r == 0 or ids[r - 1] is None else str(ids[r - 1]))
        for r, pid, _, _ in rows
        if pid is not None and len(set(groups[pid])) > 1
    }
    previous = F.col("previous_id").cast("double").cast("bigint").cast("string")
    found = plain.filter("type = 'duplicate_id'").select("row_index", previous.alias("previous_id"))
    assert {tuple(f) for f in found.collect()} == want


def test_input_partitioning_does_not_matter(spark):
    df = experiment(spark)
    assert same_rows(
        out_of_sequence_ids(df.repartition(13), "pid", "grp"),
        out_of_sequence_ids(df.coalesce(1), "pid", "grp"),
    )


def test_previous_ids(spark):
    df = spark.createDataFrame([(0, 4, "a", 0.0), (1, None, "a", 0.0), (2, 6, "a", 0.0)], SCHEMA)
    found = by(previous_ids(df, "pid").collect(), "row_index")
    assert [found[i]["previous_id"] for i in range(3)] == [None, "4", None]


def test_unknown_columns_raise(spark):
    df = experiment(spark)
    with pytest.raises(ValueError, match="nope"):
        duplicate_ids(df, "nope")
    with pytest.raises(ValueError):
        out_of_sequence_ids(df, "pid", ["nope"])


def test_known_counts_on_the_tables(spark, sf_dir):
    from catalog.ordering_queries import QUERIES

    assert QUERIES["duplicate_ids"](spark, sf_dir).count() == 13623
    assert QUERIES["out_of_sequence_ids"](spark, sf_dir).count() == 79
    assert QUERIES["out_of_sequence_string_ids"](spark, sf_dir).count() == 1485


def test_awkward_column_names(spark):
    """Dots, blanks and quotes in names, as research tables have them."""
    from tamperlens.operators.digits import terminal_digits
    from tamperlens.operators.distribution import multimodality
    from tamperlens.operators.effects import compare_with_without
    from tamperlens.operators.evidence import id_sequence, zscore_outliers
    from tamperlens.operators.inliers import inlier_bands
    from tamperlens.operators.profile import column_profile, frame_profile
    from tamperlens.plans.staging import with_row_id

    names = ["pos", "subj.id", "the group's", "r.t (ms)"]
    plain = experiment(spark).toDF("pos", "pid", "grp", "score")
    awkward = with_row_id(plain.toDF(*names), ["pos"])
    base = with_row_id(plain, ["pos"])
    ident, group, value = names[1:]
    found = sorting_anomalies(awkward, ident, group)
    known = sorting_anomalies(base, "pid", "grp")
    shown = ["row_index", "id_value", "severity", "previous_id"]
    assert same_rows(found.select(*shown), known.select(*shown))
    assert found.first()["condition_values"].keys() == {group}
    assert duplicate_ids(awkward, ident).count() == 1
    assert multimodality(awkward, [value], group).count() == 3
    assert inlier_bands(awkward, [value], group, include_overall=True).count() == 4
    assert terminal_digits(awkward, [value]).first()["column"] == value
    assert compare_with_without(awkward, [1, 2], group, [value], all_pairs=True).count() == 6
    assert id_sequence(awkward, ident, group, [3]).filter("is_suspicious").count() == 1
    assert zscore_outliers(awkward, [value]).count() == 0
    assert set(r["column"] for r in column_profile(awkward).collect()) == {"row_id", *names}
    assert frame_profile(awkward).count() == 5
