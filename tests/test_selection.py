"""Radix selection of quantiles: equal bits to the built-in percentile."""

from __future__ import annotations

import math
import random
import struct

import pytest

from tamperlens.plans.limits import Limits
from tamperlens.plans.quantiles import grouped_quantiles, ordered_key, selected_quantiles, value_of_key

WANTED = {"low": 0.0, "q1": 0.25, "median": 0.5, "p77": 0.77, "high": 1.0}


def bits(x):
    return None if x is None else struct.pack(">d", x + 0.0)


def test_keys_order_doubles_and_come_back(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, math.inf, -math.inf, 0.1, -0.1]
    values += [s * 2.0**e for e in range(-1074, 1024, 7) for s in (1, -1)]
    values += [math.nextafter(2.0**e, d) for e in range(-1020, 1023, 11) for d in (0, math.inf)]
    values += [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", f"{ordered_key('v')} AS k")
    rows = df.selectExpr("v", "k", f"{value_of_key('k')} AS back").collect()
    assert all(bits(r.v) == bits(r.back) for r in rows)
    rows.sort(key=lambda r: r.v)
    assert all((a.v < b.v) == (a.k < b.k) for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("limits", [Limits(percentile_rows=1), Limits(percentile_rows=1, hot_rows=20, max_hot_keys=3)])
def test_selection_equals_the_built_in_percentile(spark, limits):
    rng = random.Random(5)
    makers = {
        "normal": lambda: rng.gauss(0, 1), "money": lambda: round(rng.uniform(-50, 1e5), 2), "few": lambda: float(rng.randrange(3)),
        "one": lambda: 7.25, "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "near": lambda: 1 + rng.randrange(40) * 2**-52,
    }
    rows = [(k, make()) for k, make in makers.items() for _ in range(rng.randrange(300, 500))] + [("single", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r.k: r for r in grouped_quantiles(df, ["k"], "v", WANTED, 500).collect()}
    got = {r.k: r for r in grouped_quantiles(df, ["k"], "v", WANTED, 500, limits).collect()}
    assert set(got) == set(want) == {*makers, "single"}
    for k in want:
        assert [bits(got[k][n]) for n in WANTED] == [bits(want[k][n]) for n in WANTED], k


def test_selection_shuffles_counts_only(spark):
    """No range sort, and integer columns are known before the last digits."""
    df = spark.range(50_000).selectExpr("id % 3 AS k", "CAST(id % 1000 AS INT) AS v")
    found = selected_quantiles(df, ["k"], "v", {"median": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert {r.k: r["median"] for r in found.collect()} == {r.k: r["median"] for r in grouped_quantiles(df, ["k"], "v", {"median": 0.5}, 1).collect()}


def test_weights_stand_for_equal_values(spark):
    df = spark.range(900).selectExpr("id % 2 AS k", "CAST(id * id % 41 AS DOUBLE) - 9 AS v")
    counts = df.groupBy("k", "v").count()
    want = {r.k: r for r in grouped_quantiles(df, ["k"], "v", WANTED, 450).collect()}
    for limits in (Limits(), Limits(percentile_rows=1), Limits(percentile_rows=1, hot_rows=20, max_hot_keys=3)):
        got = grouped_quantiles(counts, ["k"], "v", WANTED, 450, limits, "count").collect()
        assert {r.k: r for r in got} == want
