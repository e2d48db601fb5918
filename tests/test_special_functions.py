"""Tail probabilities against the JVM's math library, normality against published values."""

from __future__ import annotations

import numpy as np
import pytest

from shapiro_reference import shapiro_wilk

from tamperlens.operators.distribution import shapiro_normality
from tamperlens.functions.tails import beta_cdf, chi_square_tail_9, t_two_sided


def test_chi_square_tail(spark):
    law = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(9.0)
    for x in (0.0, 0.5, 3.3, 8.857333, 16.918977604620448, 27.87716487125657, 80.0):
        assert chi_square_tail_9(x) == pytest.approx(1 - law.cumulativeProbability(x), abs=1e-12)


def test_chi_square_critical_values():
    assert chi_square_tail_9(16.918977604620448) == pytest.approx(0.05)
    assert chi_square_tail_9(21.665994333461924) == pytest.approx(0.01)
    assert chi_square_tail_9(27.87716487125657) == pytest.approx(0.001)


def test_t_tail(spark):
    maths = spark._jvm.org.apache.commons.math3.distribution
    for t in (-8.0, -2.1, -0.3, 0.0, 0.7, 1.96, 12.0):
        for freedom in (1.0, 2.5, 17.3, 250.0, 40000.0):
            law = maths.TDistribution(freedom)
            assert t_two_sided(t, freedom) == pytest.approx(
                2 * law.cumulativeProbability(-abs(t)), rel=1e-8, abs=1e-14
            )


def test_t_tail_ends():
    assert t_two_sided(float("inf"), 3) == 0
    assert np.isnan(t_two_sided(float("nan"), 3))


def test_beta_ends():
    assert beta_cdf(2, 3, 0) == 0 and beta_cdf(2, 3, 1) == 1
    assert beta_cdf(2, 2, 0.5) == pytest.approx(0.5)


# published: weights of eleven men (Shapiro and Wilk 1965); fuel use of 32 cars
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
CARS = (
    "21 21 22.8 21.4 18.7 18.1 14.3 24.4 22.8 19.2 17.8 16.4 17.3 15.2 10.4 10.4 14.7 32.4 30.4 33.9 "
    "21.5 15.5 15.2 13.3 19.2 27.3 26 30.4 15.8 19.7 15 21.4"
)


def test_shapiro_small_sample():
    w, p = shapiro_wilk(np.array(WEIGHTS))
    assert w == pytest.approx(0.78881, abs=5e-5)
    assert p == pytest.approx(0.006704, abs=5e-6)


def test_shapiro_larger_sample():
    w, p = shapiro_wilk(np.array([float(v) for v in CARS.split()]))
    assert w == pytest.approx(0.94756, abs=5e-5)
    assert p == pytest.approx(0.1229, abs=5e-5)


def test_shapiro_does_not_depend_on_scale_or_order():
    x = np.random.default_rng(1).gamma(2, size=400)
    w, p = shapiro_wilk(x)
    assert shapiro_wilk(1000 - 3 * x[::-1]) == pytest.approx((w, p), rel=1e-6)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 13, 20, 60, 500])
def test_shapiro_by_sums_equals_the_sample_version(spark, n):
    rng = np.random.default_rng(n)
    samples = {"plain": rng.normal(size=n), "ties": np.round(rng.gamma(2, size=n) * 4), "skewed": rng.exponential(size=n)}
    rows = [(g, float(v)) for g, x in samples.items() for v in x]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["group"]: r for r in shapiro_normality(df, ["v"], "g", min_values=3).collect()}
    for g, x in samples.items():
        if x.min() < x.max():
            assert (found[g]["shapiro_w"], found[g]["shapiro_p"]) == pytest.approx(shapiro_wilk(x), rel=1e-6, abs=1e-9)


def test_shapiro_constant():
    assert np.isnan(shapiro_wilk(np.ones(30))[1])
