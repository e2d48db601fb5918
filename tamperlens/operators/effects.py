"""Group comparisons with and without suspicious rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import (
    clean_sql,
    long_form,
    numeric_columns,
    present_columns,
    quoted,
    require_columns,
    text_literal,
)
from tamperlens.functions.labels import effect_label, z_label
from tamperlens.functions.tails import welch_p
from tamperlens.operators.rows import flag_rows, rows_frame
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.quantiles import grouped_quantiles
from tamperlens.plans.staging import stage, stage_keys

# fixed values: scope names and thresholds
FULL, WITHOUT, ONLY = "full_dataset", "without_suspicious", "suspicious_only"
SIGNIFICANT_P = 0.05
UNUSUAL_Z = 1.5
# pair production of one outcome is divided among this many join keys
PAIR_SPREAD = 16
# below this share of the group's variation a leave-one-out remainder is rounding
ROUNDING = 1e-12

Rows = DataFrame | Iterable[int]


def _flagged_cells(
    df: DataFrame, rows: Rows, group: str, outcomes: Sequence[str], row_id: str
) -> DataFrame:
    """(row_id, is_suspicious, _g, column, value) of rows that have a group."""
    require_columns(df, [row_id, group])
    names = numeric_columns(df, present_columns(df, outcomes))
    narrow = df.selectExpr(
        quoted(row_id),
        f"cast({clean_sql(df, group)} AS STRING) AS _g",
        *[quoted(c) for c in names],
    )
    flagged = flag_rows(narrow.filter("_g IS NOT NULL"), rows, row_id)
    return long_form(flagged, names, [row_id, "is_suspicious", "_g"])


def _scoped(cells: DataFrame) -> DataFrame:
    """Every cell in the full scope and in the one its row belongs to."""
    scopes = f"explode(array('{FULL}', if(is_suspicious, '{ONLY}', '{WITHOUT}'))) AS scope"
    return cells.selectExpr("*", scopes).withColumnRenamed("column", "outcome")


def _summaries(scoped: DataFrame) -> DataFrame:
    return scoped.groupBy("scope", "outcome", "_g").agg(
        F.expr("count(*) AS n"), F.expr("avg(value) AS mean"), F.expr("var_samp(value) AS var")
    )


def group_order(df: DataFrame, group: str, row_id: str = "row_id") -> DataFrame:
    """(_g, first_row), groups by first appearance; NULL groups drop."""
    keyed = df.selectExpr(f"cast({clean_sql(df, group)} AS STRING) AS _g", f"{quoted(row_id)} AS _row")
    return keyed.filter("_g IS NOT NULL").groupBy("_g").agg(F.expr("min(_row) AS first_row"))


def _pairs(
    groups: DataFrame, per_group: DataFrame, outcomes: Sequence[str], against: str | None, all_pairs: bool
) -> DataFrame:
    """Ordered group pairs per scope and outcome, summaries on both sides.

    Each group meets the group ``against``, or the first one to appear; with
    ``all_pairs`` every pair is formed, which grows with the square of the groups.
    """
    scopes = ", ".join(f"'{scope}'" for scope in (FULL, WITHOUT, ONLY))
    names = ", ".join(text_literal(o) for o in outcomes)
    grid = groups.selectExpr("*", f"explode(array({scopes})) AS scope").selectExpr(
        "*", f"explode(array({names})) AS outcome"
    )
    # one row per scope, outcome and group; both sides of the pairing read it
    filled = stage(
        grid.join(per_group, ["scope", "outcome", "_g"], "left").withColumn(
            "n", F.expr("coalesce(n, 0L)")
        )
    )

    def side(i: int, salt: str) -> DataFrame:
        renamed = [f"{c} AS {c}{i}" for c in ("_g", "first_row", "n", "mean", "var")]
        return filled.selectExpr("scope", "outcome", f"{salt} AS _salt", *renamed)

    if not all_pairs:
        own = F.col("_g") == against if against is not None else None
        named = groups.filter(own) if own is not None else groups.orderBy("first_row").limit(1)
        # a row for each scope and outcome: the columns of the table bound it
        base = side(1, "0L").join(F.broadcast(named.select(F.col("_g").alias("_g1"))), "_g1")
        few = F.broadcast(base.select("scope", "outcome", *[f"{c}1" for c in ("_g", "first_row", "n", "mean", "var")]))
        return side(2, "0L").join(few, ["scope", "outcome"]).filter("_g1 <> _g2")
    left = side(1, f"pmod(xxhash64(_g), {PAIR_SPREAD}L)")
    right = side(2, f"explode(sequence(0L, {PAIR_SPREAD - 1}L))")
    return left.join(right, ["scope", "outcome", "_salt"]).filter("first_row1 < first_row2")


def _compare(pairs: DataFrame) -> DataFrame:
    """E2-E4 from the sufficient statistics of both sides."""

    def known(sql: str, name: str) -> str:
        return f"if(_enough, {sql}, NULL) AS {name}"

    # without any variance the statistic is infinite, or undefined for equal means
    t = (
        "CASE WHEN _e1 + _e2 > 0 THEN -mean_difference / sqrt(_e1 + _e2) "
        "WHEN mean_difference <> 0 THEN -signum(mean_difference) * double('Infinity') END"
    )
    freedom = (
        "coalesce(pow(_e1 + _e2, 2) / nullif(pow(_e1, 2) / (n1 - 1) + pow(_e2, 2) / (n2 - 1), 0D), 1D)"
    )
    return (
        pairs.selectExpr("*", "n1 >= 2 AND n2 >= 2 AS _enough")
        .filter(f"_enough OR scope <> '{ONLY}'")
        .selectExpr(
            "*",
            known("mean2 - mean1", "mean_difference"),
            known("var1 / n1", "_e1"),
            known("var2 / n2", "_e2"),
            known("sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2))", "_pooled"),
        )
        .selectExpr(
            "*",
            known(t, "t_statistic"),
            known(freedom, "_df"),
            known("if(_pooled > 0, mean_difference / _pooled, 0D)", "cohens_d"),
        )
        .withColumn("_p", welch_p("t_statistic", "_df"))
        .selectExpr(
            "*",
            "nullif(_p, double('NaN')) AS p_value",
            f"{effect_label('cohens_d')} AS effect_size_interpretation",
            known(f"coalesce(_p < {SIGNIFICANT_P} AND NOT isnan(_p), false)", "significant"),
            "if(_enough, NULL, 'too few values to compare') AS error",
        )
    )


def compare_with_without(
    df: DataFrame,
    rows: Rows,
    group: str,
    outcomes: Sequence[str],
    row_id: str = "row_id",
    against: str | None = None,
    all_pairs: bool = False,
) -> DataFrame:
    """Welch test and Cohen's d of group pairs in three scopes.

    Each group is compared with the group ``against``, or with the first one to
    appear; ``all_pairs`` compares every two groups.
    Pairs with fewer than two values on a side give an ``error`` row, except in
    the suspicious-only scope, where they are left out.  The sign of
    ``cohens_d`` is that of second minus first group, opposite to the t value.
    """
    names = numeric_columns(df, present_columns(df, outcomes))
    cells = _flagged_cells(df, rows, group, names, row_id)
    per_group = _summaries(_scoped(cells))
    pairs = _pairs(group_order(df, group, row_id), per_group, names, against, all_pairs)
    return _compare(pairs).selectExpr(
        "scope",
        "outcome",
        "_g1 AS group1",
        "_g2 AS group2",
        "concat(_g1, ' vs ', _g2) AS pair",
        "t_statistic",
        "p_value",
        "mean_difference",
        "cohens_d",
        "n1",
        "n2",
        "effect_size_interpretation",
        "significant",
        "error",
    )


def descriptive_stats(
    df: DataFrame,
    rows: Rows,
    group: str,
    outcomes: Sequence[str],
    row_id: str = "row_id",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Mean, median, deviation and range per scope, outcome and group."""
    scoped = _scoped(_flagged_cells(df, rows, group, outcomes, row_id))
    keys = ["scope", "outcome", "_g"]
    stats, sizes = stage_keys(
        scoped.groupBy(*keys).agg(
            F.expr("avg(value) AS mean"),
            F.expr("coalesce(stddev_samp(value), 0D) AS std"),
            F.expr("min(value) AS min"),
            F.expr("max(value) AS max"),
            F.expr("count(*) AS n"),
        ),
        "n",
    )
    medians = grouped_quantiles(scoped, keys, "value", {"median": 0.5}, sizes.largest, limits)
    return stats.join(medians, keys).selectExpr(
        "scope", "outcome", "_g AS `group`", "mean", "median", "std", "min", "max", "n"
    )


def significance_change(
    df: DataFrame,
    rows: Rows,
    group: str,
    outcomes: Sequence[str],
    row_id: str = "row_id",
    against: str | None = None,
    all_pairs: bool = False,
) -> DataFrame:
    """Per outcome and pair, what removing the suspicious rows changes.

    Pairs are those of ``compare_with_without`` with the same arguments.
    Percent changes compare the column without the rows to the column with them.
    """
    listed = rows_frame(df.sparkSession, rows)
    compared = compare_with_without(df, listed, group, outcomes, row_id, against, all_pairs)

    def of(scope: str, column: str, name: str) -> Column:
        return F.expr(f"max(if(scope = '{scope}', {column}, NULL)) AS {name}")

    pairs = compared.filter(f"scope <> '{ONLY}'").groupBy("outcome", "pair").agg(
        of(FULL, "cohens_d", "with_effect_size"),
        of(WITHOUT, "cohens_d", "without_effect_size"),
        of(FULL, "p_value", "with_p_value"),
        of(WITHOUT, "p_value", "without_p_value"),
        of(FULL, "coalesce(significant, false)", "_with"),
        of(WITHOUT, "coalesce(significant, false)", "_without"),
    )
    names = numeric_columns(df, present_columns(df, outcomes))
    narrow = df.selectExpr(*[quoted(c) for c in [row_id, *names]])
    flagged = flag_rows(narrow, listed, row_id)
    columns = (
        long_form(flagged, names, ["is_suspicious"])
        .withColumnRenamed("column", "outcome")
        .groupBy("outcome")
        .agg(
            F.expr("avg(value) AS with_mean"),
            F.expr("avg(value) FILTER (WHERE NOT is_suspicious) AS without_mean"),
            F.expr("stddev_samp(value) AS with_std"),
            F.expr("stddev_samp(value) FILTER (WHERE NOT is_suspicious) AS without_std"),
        )
    )

    def percent(what: str) -> str:
        before, after = f"with_{what}", f"without_{what}"
        return f"({after} - {before}) / nullif(abs({before}), 0D) * 100 AS {what}_change_percent"

    return pairs.join(columns, "outcome").selectExpr(
        "outcome AS `column`",
        "pair",
        "with_mean",
        "without_mean",
        "with_std",
        "without_std",
        percent("mean"),
        percent("std"),
        "with_effect_size",
        "without_effect_size",
        "with_p_value",
        "without_p_value",
        "coalesce(_with, false) <> coalesce(_without, false) AS significance_changed",
    )


def suspicious_effects(
    df: DataFrame,
    rows: Rows,
    group: str,
    outcomes: Sequence[str],
    row_id: str = "row_id",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Listed rows that stand far from their group.

    The distance is to the mean of the whole group, the deviation is that of the
    group without the row, both from n, mean and squared deviations alone.
    """
    cells = _flagged_cells(df, rows, group, outcomes, row_id)
    keys = ["column", "_g"]
    stats, sizes = stage_keys(
        cells.groupBy(*keys).agg(
            F.expr("count(*) AS n"),
            F.expr("avg(value) AS group_mean"),
            F.expr("var_pop(value) * count(*) AS _m2"),
        ),
        "n",
    )
    listed = cells.filter("is_suspicious")
    joined = attach_by_key(listed, stats, keys, "n", limits, sizes).filter("n >= 3")
    spread = f"if(_rest > _m2 * {ROUNDING}D, sqrt(_rest / (n - 2)), NULL)"
    return (
        joined.selectExpr("*", "value - group_mean AS difference")
        .selectExpr("*", "_m2 - difference * difference * n / (n - 1) AS _rest")
        .selectExpr("*", f"difference / {spread} AS z_score")
        .filter(f"abs(z_score) > {UNUSUAL_Z}")
        .selectExpr(
            f"{quoted(row_id)} AS row_index",
            "_g AS `group`",
            "`column` AS outcome",
            "value",
            "group_mean",
            "difference",
            "z_score",
            "if(difference > 0, 'stronger', 'weaker') AS effect_direction",
            f"{z_label('z_score')} AS magnitude",
            "'suspicious_effect' AS type",
        )
    )
