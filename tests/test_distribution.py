"""Digits, shape and crowding checks on planted values and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import by, same_rows

from tamperlens.operators.digits import digit_histogram, keep_suspicious, terminal_digits
from tamperlens.operators.distribution import (
    density_grid,
    density_peaks,
    distribution_stats,
    gap_analysis,
    multimodality,
    shapiro_normality,
)
from tamperlens.operators.inliers import inlier_bands

NAN = float("nan")


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


# --- digits ---------------------------------------------------------------


def test_digit_columns_and_tiers(spark):
    n = 400
    rows = [
        (
            float(i % 10) + 0.5,
            float(5 if i % 4 else i % 10),
            float(0 if i % 3 else i % 10),
            float(2 * (i % 5)),
            i % 100 / 100,
            -(i * 13 % 1000),
            float(i) if i < 19 else None,
        )
        for i in range(n)
    ]
    schema = "v_uniform double, v_heaped5 double, v_heaped0 double, v_even double, v_cents double, v_int bigint, v_short double"
    found = by(terminal_digits(spark.createDataFrame(rows, schema)).collect(), "column")
    assert found["v_short"]["error"] and found["v_short"]["suspicion"] is None and found["v_short"]["sample_size"] == 19
    assert found["v_uniform"]["suspicion"] == "none" and found["v_uniform"]["suspicion_score"] == 3
    assert found["v_uniform"]["p_value"] == pytest.approx(1) and found["v_uniform"]["entropy"] == pytest.approx(1)
    assert found["v_heaped5"]["suspicion"] == "high" and found["v_heaped5"]["most_common_digit"] == 5
    assert found["v_heaped5"]["patterns_detected"] == ["digit_5_overrepresented"]
    assert "digit_0_overrepresented" in found["v_heaped0"]["patterns_detected"]
    assert found["v_even"]["patterns_detected"] == ["even_digits_overrepresented"]
    assert found["v_even"]["least_common_digit"] == 0  # only digits that occur count
    assert found["v_cents"]["terminal_digit_counts"]["0"] == n  # the ones digit, not the last decimal
    assert found["v_int"]["suspicion"] == "none"


def test_digit_edge_values(spark):
    values = [0.0, 0.25, -17.9, 1e16, 9007199254740993.0, 1e300, NAN, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = by(digit_histogram(df, ["v"], min_values=1).collect(), "digit")
    counted = {d: r["count"] for d, r in found.items() if r["count"]}
    expected = {}
    for v in (0.0, 0.25, 17.9, 1e16, 9007199254740993.0, 1e300):
        expected[int(v) % 10] = expected.get(int(v) % 10, 0) + 1
    assert counted == expected and len(found) == 10


def test_digit_types(spark):
    df = spark.sql(
        "SELECT cast(-9223372036854775808 AS BIGINT) AS big, true AS flag, cast(-123.99 AS DECIMAL(9,2)) AS d, "
        "cast(7.5 AS FLOAT) AS f, cast(-4 AS TINYINT) AS t, 'x' AS s FROM range(20)"
    )
    found = by(terminal_digits(df).collect(), "column")
    assert {c: r["most_common_digit"] for c, r in found.items()} == {"big": 8, "flag": 1, "d": 3, "f": 7, "t": 4}


def test_digit_tier_boundaries(spark):
    """Tiers through critical values agree with the p-value tiers."""
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in r) for r in rng.integers(0, 1000, size=(60, 40))]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(40)))
    for r in terminal_digits(df).collect():
        p = r["p_value"]
        assert r["suspicion"] == ("high" if p < 0.001 else "medium" if p < 0.01 else "low" if p < 0.05 else "none")


def test_keep_suspicious(spark):
    df = spark.createDataFrame([("high",), ("medium",), ("low",), ("none",), (None,)], "suspicion string")
    assert [r[0] for r in keep_suspicious(df).orderBy("suspicion").collect()] == ["high", "medium"]


def test_no_numeric_columns_gives_no_rows(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        terminal_digits(df, ["missing"])


# --- shape ----------------------------------------------------------------

RNG = np.random.default_rng(11)
SHAPES = {
    "normal": RNG.normal(10, 2, 300),
    "bimodal": np.concatenate([RNG.normal(0, 1, 150), RNG.normal(20, 1, 150)]),
    "gap": np.concatenate([np.arange(100.0), [500.0]]),
    "constant": [4.0] * 30,
    "short": np.arange(19.0),
    "enough": np.arange(20.0),
    "holes": [*np.arange(25.0), NAN, None],
    None: np.arange(40.0),
}


def kde(values):
    x = np.linspace(values.min(), values.max(), 100)
    h = values.std(ddof=1) * len(values) ** -0.2
    return x, np.exp(-(((x[:, None] - values) / h) ** 2) / 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))


def test_stats_by_group(spark):
    found = by(distribution_stats(frame(spark, SHAPES), ["v"], "g").collect(), "group")
    assert sorted(found) == ["bimodal", "constant", "enough", "gap", "holes", "normal", "short"]
    assert found["short"]["error"] and found["short"]["mean"] is None
    for name in ("normal", "bimodal", "gap"):
        v, row = np.asarray(SHAPES[name]), found[name]
        z = (v - v.mean()) / v.std()
        assert row["mean"] == pytest.approx(v.mean()) and row["median"] == pytest.approx(np.median(v))
        assert row["std_dev"] == pytest.approx(v.std(ddof=1))
        assert row["skewness"] == pytest.approx((z**3).mean())
        assert row["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert found["holes"]["sample_size"] == 25


def test_overall_and_groups_in_one_pass(spark):
    df = frame(spark, SHAPES)
    both = distribution_stats(df, ["v"], "g", include_overall=True)
    apart = distribution_stats(df, ["v"], "g").union(distribution_stats(df, ["v"]))
    assert same_rows(both, apart)
    # rows without a group count overall
    assert by(both.collect(), "group")[None]["sample_size"] == sum(
        1 for vs in SHAPES.values() for v in vs if v is not None and not math.isnan(v)
    )


def test_gaps(spark):
    found = by(gap_analysis(frame(spark, SHAPES), ["v"], "g").collect(), "group")
    assert found["gap"]["max_gap_size"] == 401 and found["gap"]["suspicious_gaps"]
    assert found["enough"]["max_gap_size"] == 1 and not found["enough"]["suspicious_gaps"]
    assert found["constant"]["max_gap_size"] == 0


def test_density_and_peaks(spark):
    df = frame(spark, {k: SHAPES[k] for k in ("normal", "bimodal")})
    grid = density_grid(df, ["v"], "g").orderBy("group", "i").collect()
    peaks = by(density_peaks(df, ["v"], "g").collect(), "group", "peak_rank")
    for name in ("normal", "bimodal"):
        x, density = kde(np.asarray(SHAPES[name]))
        mine = [r for r in grid if r["group"] == name]
        assert [r["x"] for r in mine] == pytest.approx(list(x))
        assert [r["density"] for r in mine] == pytest.approx(list(density))
        inner = [i for i in range(1, 99) if density[i] > density[i - 1] and density[i] > density[i + 1]]
        best = max(inner, key=lambda i: density[i])
        assert peaks[(name, 1)]["x"] == pytest.approx(x[best])
        assert peaks[(name, 1)]["peak_count"] == len(inner)


def test_multimodality_scores(spark):
    found = by(multimodality(frame(spark, SHAPES), ["v"], "g").collect(), "group")
    two = found["bimodal"]
    assert two["peak_count"] == 2 and two["potential_multimodal"] and two["suspicious_gaps"]
    # two peaks 3, not normal 2, gap 2
    assert two["suspicion_score"] == 7 and two["suspicion"] == "high"
    assert found["constant"]["error"] == "zero variance" and found["constant"]["mean"] is None
    assert found["enough"]["suspicion"] == "none" and found["enough"]["error"] is None
    assert found["normal"]["shapiro_p"] > 0.001


def test_large_group_is_tested_and_marked(spark):
    df = frame(spark, {"big": RNG.normal(size=5001), "small": RNG.normal(size=5000)})
    found = by(shapiro_normality(df, ["v"], "g").collect(), "group")
    assert found["big"]["shapiro_p"] is not None and not found["big"]["calibrated"]
    assert found["small"]["shapiro_p"] is not None and found["small"]["calibrated"]


def test_distributed_plans_give_the_same_rows(spark, tiny):
    df = frame(spark, SHAPES)
    for check in (distribution_stats, gap_analysis, density_peaks, shapiro_normality, multimodality, inlier_bands):
        assert same_rows(check(df, ["v"], "g"), check(df, ["v"], "g", limits=tiny)), check.__name__


def test_result_does_not_depend_on_partitions(spark):
    df = frame(spark, SHAPES)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        few = multimodality(df.repartition(5), ["v"], "g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    many = by(multimodality(df.repartition(11), ["v"], "g").collect(), "group")
    for row in few:
        assert row["suspicion_score"] == many[row["group"]]["suspicion_score"]


# --- crowding -------------------------------------------------------------


def test_inlier_bands(spark):
    crowded = [*RNG.normal(0, 0.01, 90), -30.0, 30.0]
    spread = list(RNG.normal(0, 1, 400))
    found = by(
        inlier_bands(frame(spark, {"crowded": crowded, "spread": spread, "flat": [1.0] * 25}), ["v"], "g").collect(),
        "group",
    )
    row = found["crowded"]
    assert (row["very_close_count"], row["far_count"]) == (90, 2)
    # too many near the mean 3, band shares otherwise unremarkable; 2 of 92 is below half the expected share 0
    assert row["very_close_ratio"] == pytest.approx(90 / 92 / 0.383)
    assert row["suspicion"] in ("medium", "high")
    v = np.asarray(spread)
    z = abs((v - v.mean()) / v.std(ddof=1))
    mine = found["spread"]
    assert mine["very_close_count"] == (z < 0.5).sum() and mine["close_count"] == ((z >= 0.5) & (z < 1)).sum()
    assert mine["moderate_count"] == ((z >= 1) & (z < 2)).sum() and mine["far_count"] == (z >= 2).sum()
    assert found["flat"]["error"] == "no spread of values" and found["flat"]["sample_size"] == 25
    assert found["flat"]["suspicion"] is None


def test_known_values_on_the_tables(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stats = by(distribution_stats(events, ["value"], "event_type").collect(), "group")
    assert stats["click"]["kurtosis"] == pytest.approx(6.066837, abs=1e-6)
    gaps = by(gap_analysis(events, ["value"], "event_type").collect(), "group")
    assert [round(gaps[g]["max_gap_size"], 2) for g in ("click", "error", "view")] == [103.43, 26.0, 55.9]
    bands = by(inlier_bands(events, ["value"], "event_type").collect(), "group")["view"]
    assert [bands[f"{b}_count"] for b in ("very_close", "close", "moderate", "far")] == [724, 904, 249, 105]


@pytest.mark.parametrize("check", [gap_analysis, density_grid, density_peaks, shapiro_normality])
def test_small_groups_come_back_with_an_error(spark, check):
    df = frame(spark, {"normal": SHAPES["normal"], "tiny": [1.0, 2.0, 4.0]})
    rows = check(df, ["v"], "g").collect()
    assert [r["error"] for r in rows if r["group"] == "tiny"] == ["fewer than 20 values"]
    others = [r["error"] for r in rows if r["group"] == "normal"]
    assert others and set(others) == {None}
