"""Terminal-digit checks over many columns in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperlens.functions.columns import (
    is_floating,
    long_form,
    numeric_columns,
    present_columns,
    quoted,
)
from tamperlens.functions.labels import tier_score
from tamperlens.functions.tails import chi_square_p

# fixed values: chi-square critical values for nine degrees of freedom, and the
# shares above which a digit pattern is named
CRITICAL_001 = 27.87716487125657
CRITICAL_01 = 21.665994333461924
CRITICAL_05 = 16.918977604620448
EVEN_SHARE = 0.65
SINGLE_DIGIT_SHARE = 0.2
MIN_VALUES = 20

DIGITS = [f"d{d}" for d in range(10)]


def terminal_digit(df: DataFrame, column: str) -> str:
    """SQL of the ones digit; NULL for NULL, NaN and infinities."""
    kind, name = df.schema[column].dataType, quoted(column)
    if is_floating(kind):
        # the floating remainder is exact, also beyond the BIGINT range; NaN
        # compares as greater than infinity
        size = f"abs(cast({name} AS DOUBLE))"
        return f"CASE WHEN {size} < double('Infinity') THEN cast(floor({size} % 10D) AS INT) END"
    if isinstance(kind, T.BooleanType):
        return f"cast({name} AS INT)"
    if isinstance(kind, T.DecimalType):
        return f"cast(floor(abs({name})) % 10 AS INT)"
    # remainder before abs: the most negative BIGINT has no positive twin
    return f"cast(abs({name} % 10) AS INT)"


def _digit_counts(df: DataFrame, columns: Sequence[str] | None, min_values: int | None) -> DataFrame:
    """One row per checked column with the ten counts ``d0`` … ``d9``."""
    chosen = df.columns if columns is None else present_columns(df, columns)
    cells = long_form(df, numeric_columns(df, chosen), value="digit", expression=terminal_digit)
    counts = cells.groupBy("column").agg(
        F.expr("count(*) AS sample_size"),
        *[F.expr(f"count_if(digit = {d}) AS d{d}") for d in range(10)],
    )
    return counts if min_values is None else counts.filter(f"sample_size >= {min_values}")


def digit_histogram(
    df: DataFrame, columns: Sequence[str] | None = None, min_values: int = MIN_VALUES
) -> DataFrame:
    """(column, digit, count) with all ten digits, absent ones at zero."""
    bars = ", ".join(f"struct({d} AS digit, d{d} AS count)" for d in range(10))
    return _digit_counts(df, columns, min_values).selectExpr("column", f"inline(array({bars}))")


def digit_tier(chi_square: str) -> str:
    """SQL of the tier through the critical values, the same as through the p-value."""
    return (
        f"CASE WHEN {chi_square} > {CRITICAL_001}D THEN 'high' "
        f"WHEN {chi_square} > {CRITICAL_01}D THEN 'medium' "
        f"WHEN {chi_square} > {CRITICAL_05}D THEN 'low' ELSE 'none' END"
    )


def terminal_digits(
    df: DataFrame, columns: Sequence[str] | None = None, min_values: int = MIN_VALUES
) -> DataFrame:
    """Uniformity of the ones digit, one row per column.

    A column of fewer than ``min_values`` finite values has counts and ``error``
    only.  Ties for the most and least common digit go to the smaller digit.
    """
    n = "sample_size"
    chi_square = " + ".join(f"pow({d} - {n} / 10D, 2) / ({n} / 10D)" for d in DIGITS)
    entropy = " + ".join(f"if({d} > 0, -({d} / {n}) * log2({d} / {n}), 0D)" for d in DIGITS)
    seen = ", ".join(f"if(d{d} > 0, struct(d{d} AS n, {d} AS digit), NULL)" for d in range(10))
    # largest count, then smallest digit
    ranked = "array_max(transform(_seen, s -> struct(s.n, -s.digit AS d)))"
    patterns = (
        f"if((d0 + d2 + d4 + d6 + d8) / {n} > {EVEN_SHARE}, 'even_digits_overrepresented', NULL), "
        f"if(d5 / {n} > {SINGLE_DIGIT_SHARE}, 'digit_5_overrepresented', NULL), "
        f"if(d0 / {n} > {SINGLE_DIGIT_SHARE}, 'digit_0_overrepresented', NULL)"
    )
    enough = f"{n} >= {min_values}"
    scored = _digit_counts(df, columns, None).selectExpr(
        "*", f"if({enough}, {chi_square}, NULL) AS chi_square", f"array_compact(array({seen})) AS _seen"
    )
    counts = ", ".join(f"'{d}', d{d}" for d in range(10))
    result = scored.selectExpr(
        "column",
        f"map({counts}) AS terminal_digit_counts",
        "chi_square",
        f"if({enough}, ({entropy}) / log2(10D), NULL) AS entropy",
        f"if({enough}, {digit_tier('chi_square')}, NULL) AS suspicion",
        f"if({enough}, -{ranked}.d, NULL) AS most_common_digit",
        f"if({enough}, array_min(_seen).digit, NULL) AS least_common_digit",
        f"if({enough}, array_compact(array({patterns})), NULL) AS patterns_detected",
        n,
        f"if({enough}, NULL, 'fewer than {min_values} values') AS error",
    )
    return result.withColumns(
        {"p_value": chi_square_p("chi_square"), "suspicion_score": F.expr(f"if(error IS NULL, {tier_score('suspicion')}, NULL)")}
    )


def keep_suspicious(results: DataFrame) -> DataFrame:
    """Rows of a digit, distribution or inlier result worth reporting."""
    return results.filter("suspicion IN ('medium', 'high')")
