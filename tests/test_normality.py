"""Normality from closed sums of normal scores, against one score for each rank."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from conftest import by
from shapiro_reference import shapiro_wilk

from tamperlens.functions.normality import score_integral, share_of_rank, square_integral, with_quantiles
from tamperlens.operators import distribution
from tamperlens.operators.distribution import shapiro_normality
from tamperlens.plans.limits import DEFAULT_LIMITS
from tamperlens.plans.staging import Sizes, stage


def _normal_scores(n):
    normal = NormalDist()
    return np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])


def test_closed_sums_of_normal_scores(spark):
    """Sums over ranges of ranks and of squares against one score for each rank."""
    for n in (130, 131, 1000, 20_000):
        scores = _normal_scores(n)
        rng = np.random.default_rng(n)
        ends = sorted({int(x) for x in rng.integers(65, n - 63, 40)} | {65, n - 64})
        ranges = [(a, b) for a in ends for b in ends if a <= b][:400]
        df = spark.createDataFrame([(n, a, b) for a, b in ranges], "n long, a long, b long")
        z = with_quantiles(df, {"z1": share_of_rank("(a - 0.5D)"), "z2": share_of_rank("(b + 0.5D)")})
        got = z.selectExpr("a", "b", f"{score_integral('z2')} - {score_integral('z1')} AS s",
            f"{square_integral(share_of_rank('(b + 0.5D)'), 'z2')} - {square_integral(share_of_rank('(a - 0.5D)'), 'z1')} AS q").collect()
        for r in got:
            own = scores[r.a - 1 : r.b]
            assert abs(r.s - own.sum()) < 1e-9 and abs(r.q - (own**2).sum()) < 1e-9


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 11, 12, 127, 128, 129, 130, 131, 400, 5000])
def test_w_of_ties_equals_the_rank_by_rank_sum(spark, n):
    rng = np.random.default_rng(n)
    samples = {
        "ties": np.round(rng.standard_normal(n) * 2) + np.arange(n) // max(n - 1, 1),
        "lumps": rng.integers(0, 3, n).astype(float) + (np.arange(n) == 0) * 5,
        "plain": rng.standard_normal(n) * 1e-3 + 1e6,
    }
    rows = [(k, float(v)) for k, values in samples.items() for v in values]
    found = by(shapiro_normality(spark.createDataFrame(rows, "g string, v double"), ["v"], "g", min_values=3).collect(), "group")
    for kind, values in samples.items():
        w, p = shapiro_wilk(values)
        assert found[kind]["shapiro_w"] == pytest.approx(w, abs=1e-9 if kind != "plain" else 1e-7)
        assert found[kind]["shapiro_p"] == pytest.approx(p, rel=1e-5 if kind != "plain" else 1e-3, abs=1e-9)


def test_a_value_is_one_row_whatever_its_count(spark):
    """Two thousand million rows as three counts: no rank is unfolded."""
    counts = [("v", "g", 1.0, 800_000_000, 0), ("v", "g", 2.0, 400_000_000, 1), ("v", "g", 4.0, 800_000_000, 2)]
    values = spark.createDataFrame(counts, "column string, _g string, value double, cnt long, _seq long").selectExpr(
        "*", "0L AS _block"
    )
    n = sum(c[3] for c in counts)
    mean = sum(c[2] * c[3] for c in counts) / n
    sum_sq = sum((c[2] - mean) ** 2 * c[3] for c in counts)
    stats = stage(spark.createDataFrame(
        [("v", "g", n, mean, math.sqrt(sum_sq / (n - 1)), 1.0, 4.0)],
        "column string, _g string, sample_size long, mean double, std_dev double, min double, max double",
    ))
    placed = distribution._with_scores(distribution._placed(values, stats, DEFAULT_LIMITS, Sizes(n, n)))
    got = distribution._shapiro(placed.groupBy("column", "_g").agg(*distribution._score_aggregates()), stats)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    # for so many rows W is the squared correlation of the values with normal scores
    z = [NormalDist().inv_cdf(p) for p in (0.4, 0.6)]
    d = [math.exp(-x * x / 2) / math.sqrt(2 * math.pi) for x in z]
    linear = n * (1.0 * -d[0] + 2.0 * (d[0] - d[1]) + 4.0 * d[1])
    w = linear**2 / (n * sum_sq)
    assert got.first()["shapiro_w"] == pytest.approx(w, abs=1e-6)
