"""Shape checks of numeric columns, overall and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import (
    grouped_long,
    numeric_columns,
    present_columns,
    require_columns,
)
from tamperlens.functions.labels import score_tier
from tamperlens.functions.normality import (
    CALIBRATED_ROWS,
    EDGE_RANKS,
    edge_sum,
    score_integral,
    shapiro_w,
    shapiro_z,
    share_of_rank,
    square_integral,
    with_quantiles,
)
from tamperlens.functions.tails import normal_tail
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.quantiles import grouped_quantiles, quantile_columns
from tamperlens.plans.staging import Sizes, along_order, stage, stage_keys, stage_sorted

KEYS = ["column", "_g"]

# fixed values: thresholds of the shape checks
MIN_VALUES = 20
GRID_POINTS = 100
TOP_PEAKS = 3
PEAK_SHARE = 0.7
NORMALITY_P = 0.001
FAR_KURTOSIS = 2.0
FLAT_KURTOSIS = -0.5
GAP_FACTOR = 5.0
# group name standing for "no group" inside join keys; data groups get a prefix
_OVERALL = "-"


def _cells(
    df: DataFrame, columns: Sequence[str] | None, by: str | None, include_overall: bool
) -> DataFrame:
    """(column, _g, value) with a non-null key for the overall distribution."""
    if by is not None:
        require_columns(df, [by])
    chosen = df.columns if columns is None else present_columns(df, columns)
    names = [c for c in numeric_columns(df, chosen) if c != by]
    cells = grouped_long(df, names, by, include_overall)
    key = f"coalesce(concat('=', `group`), '{_OVERALL}') AS _g"
    return cells.selectExpr("`column`", key, "value")


def _group_name() -> Column:
    return F.expr(f"if(_g = '{_OVERALL}', NULL, substring(_g, 2)) AS `group`")


def _moments(cells: DataFrame, min_values: int) -> DataFrame:
    aggregates = {
        "sample_size": "count(*)",
        "mean": "avg(value)",
        "std_dev": "stddev_samp(value)",
        "min": "min(value)",
        "max": "max(value)",
        "skewness": "skewness(value)",
        "kurtosis": "kurtosis(value)",
    }
    summed = cells.groupBy(*KEYS).agg(*[F.expr(f"{sql} AS {c}") for c, sql in aggregates.items()])
    return summed.filter(f"sample_size >= {min_values}")


def _with_small(result: DataFrame, moments: DataFrame, min_values: int) -> DataFrame:
    """Add a row with ``error`` for every group that is too small for the check."""
    small = moments.filter(f"sample_size < {min_values}").select(
        "column", _group_name(), "sample_size", F.lit(f"fewer than {min_values} values").alias("error")
    )
    return result.unionByName(small, allowMissingColumns=True)


def distribution_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Moments and median per column and group.

    A group of fewer than ``min_values`` values has a row with ``error`` only.  Skewness and excess kurtosis are the population ones.  ``include_overall``
    adds the rows without a group (``group`` NULL) in the same pass.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(_moments(cells, 0), "sample_size")
    stats = moments.filter(f"sample_size >= {min_values}")
    medians = grouped_quantiles(cells, KEYS, "value", {"median": 0.5}, sizes.largest, limits)
    found = stats.join(medians, KEYS, "left").select(
        "column",
        _group_name(),
        "mean",
        "median",
        "std_dev",
        "min",
        "max",
        "skewness",
        "kurtosis",
        "sample_size",
        F.lit(None).cast("string").alias("error"),
    )
    return _with_small(found, moments, min_values)


def _value_counts(cells: DataFrame, stats: DataFrame, limits: Limits, sizes: Sizes) -> DataFrame:
    """Staged (column, _g, value, cnt) rows in value order, eligible keys only."""
    eligible = stats.select(*KEYS, "sample_size")
    kept = attach_by_key(cells, eligible, KEYS, "sample_size", limits, sizes)
    counts = kept.groupBy(*KEYS, "value").agg(F.count("*").alias("cnt"))
    return stage_sorted(counts, [*KEYS, "value"])


def _placed(values: DataFrame, stats: DataFrame, limits: Limits, sizes: Sizes) -> DataFrame:
    """Distinct values with running count, value before, and the moments of their key.

    Gaps, kernels, normal scores and medians are all sums and extremes over these rows.
    """
    per_key = stats.selectExpr(*KEYS, "sample_size", "mean", "std_dev", "min", "max")
    ordered = along_order(values, KEYS, "cnt", "value", "upto", "before")
    return attach_by_key(ordered, per_key, KEYS, "sample_size", limits, sizes)


def _gap_aggregates() -> list[Column]:
    return [F.expr("coalesce(max(value - before), 0D) AS max_gap_size")]


def _gaps(stats: DataFrame, widest: DataFrame) -> DataFrame:
    return stats.join(widest, KEYS, "left").selectExpr(
        *KEYS,
        "max_gap_size",
        "(max - min) / nullif(sample_size - 1, 0) AS mean_gap",
        f"max_gap_size > {GAP_FACTOR}D * ((max - min) / nullif(sample_size - 1, 0)) AS suspicious_gaps",
    )


def gap_analysis(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Widest gap between neighbouring values against the mean gap.

    A group of fewer than ``min_values`` values has a row with ``error`` only.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(_moments(cells, 0), "sample_size")
    stats = moments.filter(f"sample_size >= {min_values}")
    placed = _placed(_value_counts(cells, stats, limits, sizes), stats, limits, sizes)
    found = _gaps(stats, placed.groupBy(*KEYS).agg(*_gap_aggregates())).select(
        "column", _group_name(), "max_gap_size", "mean_gap", "suspicious_gaps", F.lit(None).cast("string").alias("error")
    )
    return _with_small(found, moments, min_values).drop("sample_size")


#: Scott's bandwidth
BANDWIDTH = "nullif(std_dev, 0D) * pow(sample_size, -0.2D)"


def _kernel_aggregates() -> list[Column]:
    """Every distinct value adds its kernel to one sum per grid point inside the task that
    holds it; one row per key and task is shuffled."""
    last = GRID_POINTS - 1

    def x(i: int) -> str:
        return "max" if i == last else f"(min + {i} * ((max - min) / {last}))"

    return [F.expr(f"sum(cnt * exp(-pow(({x(i)} - value) / h, 2) / 2)) AS k{i}") for i in range(GRID_POINTS)]


def _grid(sums: DataFrame, stats: DataFrame) -> DataFrame:
    """(column, _g, i, x, density) on the grid from minimum to maximum, of keys with a spread."""
    last = GRID_POINTS - 1
    kernels = [f"k{i}" for i in range(GRID_POINTS)]
    curve = stats.filter("std_dev > 0").selectExpr(*KEYS, "sample_size", "min", "max", f"{BANDWIDTH} AS h")
    sums = sums.select(*KEYS, *kernels).join(curve, KEYS)
    listed = ", ".join(f"k{i}" for i in range(GRID_POINTS))
    points = sums.selectExpr("*", f"posexplode(array({listed})) AS (i, _k)")
    return points.selectExpr(
        *KEYS, "i", f"if(i = {last}, max, min + i * ((max - min) / {last})) AS x",
        "_k / (sample_size * h * sqrt(2 * pi())) AS density",
    )


def _kernel_sums(cells: DataFrame, stats: DataFrame, limits: Limits, sizes: Sizes) -> DataFrame:
    placed = _placed(_value_counts(cells, stats, limits, sizes), stats, limits, sizes)
    return placed.withColumn("h", F.expr(BANDWIDTH)).groupBy(*KEYS).agg(*_kernel_aggregates())


def density_grid(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on 100 points.

    A group of fewer than ``min_values`` values has one row with ``error`` only.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(_moments(cells, 0), "sample_size")
    stats = moments.filter(f"sample_size >= {min_values}")
    grid = _grid(_kernel_sums(cells, stats, limits, sizes), stats).select(
        "column", _group_name(), "i", "x", "density", F.lit(None).cast("string").alias("error")
    )
    return _with_small(grid, moments, min_values).drop("sample_size")


def _peaks(grid: DataFrame) -> DataFrame:
    """Peaks per key; the windows span the 100 grid points of one key."""
    along = "(PARTITION BY `column`, _g ORDER BY i)"
    tops = grid.selectExpr(
        "*", f"lag(density) OVER {along} AS _l", f"lead(density) OVER {along} AS _r"
    ).filter("density > _l AND density > _r")
    return tops.groupBy(*KEYS).agg(
        F.expr("count(*) AS peak_count"),
        F.expr(f"slice(sort_array(collect_list(struct(-density AS low, i, x))), 1, {TOP_PEAKS}) AS _tops"),
    )


def density_peaks(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """(column, group, peak_rank, x, density), the three highest peaks, and their count.

    A group of fewer than ``min_values`` values has one row with ``error`` only.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(_moments(cells, 0), "sample_size")
    stats = moments.filter(f"sample_size >= {min_values}")
    peaks = _peaks(_grid(_kernel_sums(cells, stats, limits, sizes), stats))
    found = peaks.selectExpr(*KEYS, "peak_count", "posexplode(_tops) AS (_p, _top)").select(
        "column",
        _group_name(),
        F.expr("peak_count"),
        F.expr("_p + 1 AS peak_rank"),
        F.expr("_top.x AS x"),
        F.expr("-_top.low AS density"),
        F.lit(None).cast("string").alias("error"),
    )
    return _with_small(found, moments, min_values).drop("sample_size")


def _with_scores(placed: DataFrame) -> DataFrame:
    """Rows of :func:`_placed` with the sum of the normal scores of their ranks.

    A distinct value holds the ranks up to its running count, and the sum of their normal
    scores is closed: the difference of two integrals, but for the few outermost ranks. So
    a value is one row whatever its count.
    """
    # the outermost one or two ranks at either end have weights of their own
    ranks = placed.selectExpr(
        "*", "sample_size AS n", "value - mean AS x", "upto - cnt + 1 AS first", "upto AS last",
        "if(sample_size > 5, 2L, 1L) AS own", f"least({EDGE_RANKS}L, sample_size div 2) AS edge",
    ).selectExpr(
        "*", "greatest(first, edge + 1) AS inner_first", "least(last, n - edge) AS inner_last",
        "greatest(first, own + 1) AS low_first", "least(last, edge) AS low_last",
        "greatest(n + 1 - last, own + 1) AS high_first", "least(n + 1 - first, edge) AS high_last",
    )
    some = "inner_first <= inner_last"
    ends = {
        "z1": f"if({some}, {share_of_rank('(inner_first - 0.5D)')}, NULL)",
        "z2": f"if({some}, {share_of_rank('(inner_last + 0.5D)')}, NULL)",
    }
    return with_quantiles(ranks, ends).withColumn(
        "scores",
        F.expr(
            f"coalesce({score_integral('z2')} - {score_integral('z1')}, 0D) "
            f"+ {edge_sum('low_first', 'low_last')} - {edge_sum('high_first', 'high_last')}"
        ),
    )


def _score_aggregates() -> list[Column]:
    """One sum per key and the outer gaps are all that normality needs of the values."""
    def at(rank: str) -> str:
        return f"max(if(first <= {rank} AND last >= {rank}, x, NULL))"

    return [
        F.expr("sum(scores * x) AS mid"),
        F.expr(f"{at('n')} - {at('1')} AS gap1"),
        F.expr(f"{at('n - 1')} - {at('2')} AS gap2"),
    ]


def _shapiro(sums: DataFrame, stats: DataFrame, shapiro_rows: int | None = None) -> DataFrame:
    """(column, _g, shapiro_w, shapiro_p) from sums of :func:`_score_aggregates`, for groups of any size."""
    tested = stats.filter("std_dev > 0 AND sample_size >= 3")
    if shapiro_rows is not None:
        tested = tested.filter(f"sample_size <= {shapiro_rows}")
    per_key = tested.selectExpr(
        *KEYS, "sample_size AS n", "pow(std_dev, 2) * (sample_size - 1) AS sum_sq",
        f"least({EDGE_RANKS}L, sample_size div 2) AS edge",
    )
    summed = sums.select(*KEYS, "mid", "gap1", "gap2").join(per_key, KEYS)
    # sums that depend on the number of values alone
    outer = {"low1": share_of_rank("1D"), "low2": share_of_rank("2D"), "z": share_of_rank("(edge + 0.5D)")}
    summed = (
        with_quantiles(summed, outer).withColumn(
            "norm2",
            F.expr(
                f"2 * ({edge_sum('1L', 'edge', 2)}) + if(n <= 2 * {EDGE_RANKS} + 1, 0D, "  # the rank in the middle scores 0
                f"{square_integral(share_of_rank('(n - edge + 0.5D)'), '(-z)')} "
                f"- {square_integral(share_of_rank('(edge + 0.5D)'), 'z')})"
            ),
        )
    )
    three = "greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75D))), 0D)"
    return (
        summed.drop("z").selectExpr("*", f"{shapiro_w()} AS w")
        .selectExpr("*", f"{shapiro_z()} AS z")
        .withColumn("tail", normal_tail("z"))
        .selectExpr(*KEYS, "w AS shapiro_w", f"if(n = 3, {three}, tail) AS shapiro_p")
    )


def shapiro_normality(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
    shapiro_rows: int | None = None,
) -> DataFrame:
    """Shapiro-Wilk W and p of every group, by one formula.

    ``calibrated`` says whether p lies in the range its approximation was fitted
    to.  ``shapiro_rows`` leaves larger groups out if a caller wants that.  A group of
    fewer than ``min_values`` values has a row with ``error`` only.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(_moments(cells, 0), "sample_size")
    stats = moments.filter(f"sample_size >= {min_values}")
    placed = _with_scores(_placed(_value_counts(cells, stats, limits, sizes), stats, limits, sizes))
    found = _shapiro(placed.groupBy(*KEYS).agg(*_score_aggregates()), stats, shapiro_rows)
    tested = stats.join(found, KEYS, "left").select(
        "column",
        _group_name(),
        "sample_size",
        "shapiro_w",
        "shapiro_p",
        F.expr(f"sample_size <= {CALIBRATED_ROWS} AS calibrated"),
        F.lit(None).cast("string").alias("error"),
    )
    return _with_small(tested, moments, min_values)


def multimodality(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    include_overall: bool = False,
    min_values: int = MIN_VALUES,
    limits: Limits = DEFAULT_LIMITS,
    shapiro_rows: int | None = None,
) -> DataFrame:
    """Shape statistics, peaks, gaps and their additive suspicion score.

    Everything past the moments is one aggregate over one table of value counts in
    order.  A constant column yields a row with ``error`` set.
    """
    cells = _cells(df, columns, by, include_overall)
    moments, sizes = stage_keys(_moments(cells, 0), "sample_size")
    stats = moments.filter(f"sample_size >= {min_values}")
    values = _value_counts(cells, stats, limits, sizes)
    middle, median = quantile_columns("value", {"median": 0.5}, "sample_size", "upto")
    placed = _with_scores(_placed(values, stats, limits, sizes).withColumn("h", F.expr(BANDWIDTH)))
    sums = stage(
        placed.groupBy(*KEYS).agg(
            F.expr("max(sample_size) AS _n"), *middle, *_gap_aggregates(), *_kernel_aggregates(), *_score_aggregates()
        )
    )
    joined = (
        stats.join(sums.selectExpr(*KEYS, *median), KEYS, "left")
        .join(_gaps(stats, sums.select(*KEYS, "max_gap_size")), KEYS, "left")
        .join(_peaks(_grid(sums, stats)), KEYS, "left")
        .join(_shapiro(sums, stats, shapiro_rows), KEYS, "left")
        .withColumn("peak_count", F.expr("coalesce(peak_count, 0L)"))
    )
    score = (
        f"if(peak_count >= 2 AND get(_tops, 1).low / get(_tops, 0).low > {PEAK_SHARE}, 3, 0) "
        f"+ if(shapiro_p < {NORMALITY_P}, 2, 0) + if(abs(kurtosis) > {FAR_KURTOSIS}, 2, 0) "
        "+ if(suspicious_gaps, 2, 0)"
    )
    shown = [
        *("mean", "median", "std_dev", "min", "max", "skewness", "kurtosis", "shapiro_p"),
        "potential_multimodal",
        *("peak_count", "peak_values", "suspicious_gaps", "max_gap_size"),
        *("suspicion", "suspicion_score"),
    ]
    scored = joined.selectExpr(
        "*",
        f"{score} AS suspicion_score",
        f"kurtosis < {FLAT_KURTOSIS} AS potential_multimodal",
        "transform(coalesce(_tops, array()), t -> t.x) AS peak_values",
    ).withColumn("suspicion", F.expr(score_tier("suspicion_score")))
    found = scored.select(
        "column",
        _group_name(),
        *[F.expr(f"if(std_dev > 0, {c}, NULL) AS {c}") for c in shown],
        "sample_size",
        F.expr("if(std_dev > 0, NULL, 'zero variance') AS error"),
    )
    return _with_small(found, moments, min_values)
