"""Group comparisons on planted rows and on the tables."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import by, same_rows
from pyspark.sql import functions as F

from tamperlens.operators.effects import (
    compare_with_without,
    descriptive_stats,
    group_order,
    significance_change,
    suspicious_effects,
)
from tamperlens.operators.evidence import box_summary, effect_size_table, with_without_chart
from tamperlens.plans.staging import with_row_id

RNG = np.random.default_rng(2)


@pytest.fixture(scope="module")
def planted(spark):
    """Two alike groups; six high rows in the second make them differ."""
    a = RNG.normal(10, 1, 30)
    b = np.concatenate([a[:24] + 0.01, RNG.normal(16, 1, 6)])
    rows = [(i, "b" if i % 2 else "a", float((b if i % 2 else a)[i // 2]), "s") for i in range(60)]
    rows += [(60, None, 5.0, "s"), (61, "c", 3.0, "s"), (62, "a", None, "s"), (63, "b", float("nan"), "s")]
    return spark.createDataFrame(rows, "row_id bigint, g string, y double, s string")


HIGH = [49, 51, 53, 55, 57, 59]


def test_groups_in_order_of_appearance(planted):
    found = {r["_g"]: r["first_row"] for r in group_order(planted, "g").collect()}
    assert found == {"a": 0, "b": 1, "c": 61}


def test_compare(planted):
    found = by(compare_with_without(planted, HIGH, "g", ["y", "s"], all_pairs=True).collect(), "scope", "pair")
    linear = by(compare_with_without(planted, HIGH, "g", ["y", "s"]).collect(), "scope", "pair")
    assert linear == {k: r for k, r in found.items() if k[1].startswith("a vs")}
    named = compare_with_without(planted, HIGH, "g", ["y"], against="c").filter("scope = 'full_dataset'")
    assert {r["pair"] for r in named.collect()} == {"c vs a", "c vs b"}
    full, without = found[("full_dataset", "a vs b")], found[("without_suspicious", "a vs b")]
    rows = [r for r in planted.collect() if r["g"] and r["y"] is not None and r["y"] == r["y"]]
    a = np.array([r["y"] for r in rows if r["g"] == "a"])
    b = np.array([r["y"] for r in rows if r["g"] == "b"])
    t = (a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / 30 + b.var(ddof=1) / 30)
    pooled = np.sqrt((29 * a.var(ddof=1) + 29 * b.var(ddof=1)) / 58)
    assert full["t_statistic"] == pytest.approx(t)
    assert full["cohens_d"] == pytest.approx((b.mean() - a.mean()) / pooled)
    assert full["t_statistic"] < 0 < full["cohens_d"]  # opposite signs
    assert full["significant"] and not without["significant"]
    assert full["n1"] == 30 and without["n2"] == 24
    # one value on a side: error row with the counts, left out of the suspicious scope
    short = found[("full_dataset", "a vs c")]
    assert short["error"] and (short["n1"], short["n2"]) == (30, 1) and short["t_statistic"] is None
    assert found[("without_suspicious", "b vs c")]["error"]
    assert not [k for k in found if k[0] == "suspicious_only"]
    assert {r["outcome"] for r in found.values()} == {"y"}  # text outcomes are skipped


def test_no_variance(spark):
    rows = [(i, "ab"[i % 2], float(i % 2), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, y double, same double")
    found = by(compare_with_without(df, [], "g", ["y", "same"]).filter("scope = 'full_dataset'").collect(), "outcome")
    assert found["y"]["t_statistic"] == float("-inf") and found["y"]["p_value"] == 0 and found["y"]["significant"]
    assert found["y"]["cohens_d"] == 0
    assert found["same"]["t_statistic"] is None and found["same"]["p_value"] is None
    assert not found["same"]["significant"]


def test_descriptive_stats(planted, tiny):
    found = by(descriptive_stats(planted, HIGH, "g", ["y"]).collect(), "scope", "group")
    assert found[("full_dataset", "c")]["std"] == 0 and found[("full_dataset", "c")]["n"] == 1
    assert ("suspicious_only", "a") not in found and found[("suspicious_only", "b")]["n"] == 6
    assert same_rows(
        descriptive_stats(planted, HIGH, "g", ["y"]), descriptive_stats(planted, HIGH, "g", ["y"], limits=tiny)
    )


def test_significance_change(planted):
    found = by(significance_change(planted, HIGH, "g", ["y"]).collect(), "pair")
    pair = found["a vs b"]
    assert pair["significance_changed"] and pair["with_p_value"] < 0.05 < pair["without_p_value"]
    assert pair["mean_change_percent"] < 0
    assert not found["a vs c"]["significance_changed"]


def test_suspicious_effects_against_leaving_rows_out(planted, tiny):
    found = by(suspicious_effects(planted, range(64), "g", ["y"]).collect(), "row_index")
    rows = [r for r in planted.collect() if r["g"] and r["y"] is not None and r["y"] == r["y"]]
    expected = {}
    for r in rows:
        same = [x["y"] for x in rows if x["g"] == r["g"]]
        rest = [x["y"] for x in rows if x["g"] == r["g"] and x["row_id"] != r["row_id"]]
        if len(rest) > 1:
            z = (r["y"] - np.mean(same)) / np.std(rest, ddof=1)
            if abs(z) > 1.5:
                expected[r["row_id"]] = z
    assert sorted(found) == sorted(expected) and expected
    for row, z in expected.items():
        assert found[row]["z_score"] == pytest.approx(z)
        assert found[row]["effect_direction"] == ("stronger" if z > 0 else "weaker")
    assert same_rows(
        suspicious_effects(planted, range(64), "g", ["y"]),
        suspicious_effects(planted, range(64), "g", ["y"], limits=tiny),
    )


def test_rest_without_variance_is_not_flagged(spark):
    rows = [(i, "a", 7.1) for i in range(9)] + [(9, "a", 9.3)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, y double")
    assert 9 not in by(suspicious_effects(df, [9], "g", ["y"]).collect(), "row_index")


def test_effect_size_table(planted):
    # the listed rows hold group b first, then a: the difference keeps that order
    found = by(effect_size_table(planted, [1, 3, 4, 6], "g", ["y"]).collect(), "effect_size_type")
    assert len(found) == 4
    rows = {r["row_id"]: r["y"] for r in planted.collect()}
    difference = abs((rows[1] + rows[3]) / 2 - (rows[4] + rows[6]) / 2)
    assert found["Raw Difference (Suspicious)"]["effect_size"] == pytest.approx(difference)
    assert effect_size_table(planted, [1, 3], "g", ["y"]).isEmpty()  # one group only


def test_single_row_sides_have_no_cohens_d(planted):
    found = by(effect_size_table(planted, [1, 4], "g", ["y"]).collect(), "effect_size_type")
    assert found["Cohen's d (Suspicious)"]["effect_size"] == 0


def test_boxes(planted, tiny):
    found = by(box_summary(planted, HIGH, "g", ["y"]).collect(), "is_suspicious", "group")
    values = np.array([r["y"] for r in planted.collect() if r["g"] == "a" and r["y"] is not None])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    box = found[(False, "a")]
    assert (box["q1"], box["q3"]) == pytest.approx((q1, q3))
    assert (box["whisker_low"], box["whisker_high"]) == pytest.approx((inside.min(), inside.max()))
    assert box["outside"] == len(values) - len(inside)
    assert same_rows(box_summary(planted, HIGH, "g", ["y"]), box_summary(planted, HIGH, "g", ["y"], limits=tiny))


def test_chart(planted):
    found = with_without_chart(planted, HIGH, "g", ["y"]).collect()
    assert {r["measure"] for r in found} == {"mean", "effect_size", "p_value_x100"}
    assert {r["scope"] for r in found} == {"full_dataset", "without_suspicious"}


def test_known_values_on_the_tables(spark, sf_dir):
    """Every hundredth row as the listed rows; expected values were computed with SQL."""
    events = with_row_id(
        spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value"),
        ["ts", "event_id"],
    )
    listed = events.filter("row_id % 100 = 0").select(F.col("row_id").alias("row_index"))
    full = by(
        compare_with_without(events, listed, "event_type", ["value"], all_pairs=True)
        .filter("scope = 'full_dataset'")
        .collect(),
        "pair",
    )
    statistics = {frozenset(p.split(" vs ")): abs(r["t_statistic"]) for p, r in full.items()}
    assert statistics[frozenset(("click", "error"))] == pytest.approx(0.754632, abs=1e-6)
    assert statistics[frozenset(("purchase", "view"))] == pytest.approx(0.187139, abs=1e-6)
    means = by(descriptive_stats(events, listed, "event_type", ["value"]).collect(), "scope", "group")
    assert means[("suspicious_only", "click")]["mean"] == pytest.approx(61.668235, abs=1e-6)
    assert suspicious_effects(events, listed, "event_type", ["value"]).count() == 5
