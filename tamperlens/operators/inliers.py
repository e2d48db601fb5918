"""Crowding near the mean, overall and by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.labels import score_tier, tier_score
from tamperlens.operators.distribution import (
    KEYS,
    MIN_VALUES,
    _cells,
    _group_name,
    _with_small,
)
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.staging import stage_keys

# fixed values: shares each band is compared with
EXPECTED_SHARES = {"very_close": 0.383, "close": 0.348, "moderate": 0.236, "far": 0.033}


# |z| bands in the order of EXPECTED_SHARES
BANDS = {
    "very_close": "_z < 0.5D",
    "close": "_z >= 0.5D AND _z < 1D",
    "moderate": "_z >= 1D AND _z < 2D",
    "far": "_z >= 2D",
}
# Additive score of the three crowding signs
POINTS = (
    "CASE WHEN very_close_ratio > 1.5 AND very_close_count >= 10 THEN 3 "
    "WHEN very_close_ratio > 1.2 AND very_close_count >= 10 THEN 1 ELSE 0 END "
    "+ if(far_ratio < 0.5 AND sample_size >= 50, 2, 0) "
    "+ if(close_ratio > 1.3 AND moderate_ratio < 0.7, 2, 0)"
)


def inlier_bands(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    expected: Mapping[str, float] = EXPECTED_SHARES,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Counts, shares and ratios of the four |z| bands, and the score.

    Two aggregations: mean and deviation per key, then band counts with the key's
    statistics attached to its values.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(
        cells.groupBy(*KEYS).agg(
            F.expr("count(*) AS sample_size"),
            F.expr("avg(value) AS mean"),
            F.expr("stddev_samp(value) AS std_dev"),
        ),
        "sample_size",
    )
    stats = moments.filter(f"sample_size >= {min_values}")
    banded = (
        attach_by_key(cells, stats, KEYS, "sample_size", limits, sizes)
        .withColumn("_z", F.expr("abs((value - mean) / nullif(std_dev, 0D))"))
        .groupBy(*KEYS)
        .agg(*[F.expr(f"count_if({test}) AS {band}_count") for band, test in BANDS.items()])
    )
    shares = stats.join(banded, KEYS).selectExpr(
        "*", *[f"{band}_count / sample_size AS {band}_pct" for band in BANDS]
    )
    ratios = shares.selectExpr(
        "*", *[f"{band}_pct / {expected[band]}D AS {band}_ratio" for band in BANDS]
    )
    scored = ratios.selectExpr("*", f"{score_tier(f'({POINTS})')} AS suspicion")
    bands = [f"{band}_{kind}" for kind in ("count", "pct", "ratio") for band in BANDS]
    shown = ["mean", "std_dev", *bands, "suspicion"]
    found = scored.select(
        "column",
        _group_name(),
        *[F.expr(f"if(std_dev > 0, {c}, NULL) AS {c}") for c in shown],
        F.expr(f"if(std_dev > 0, {tier_score('suspicion')}, NULL) AS suspicion_score"),
        "sample_size",
        F.expr("if(std_dev > 0, NULL, 'no spread of values') AS error"),
    )
    return _with_small(found, moments, min_values)
