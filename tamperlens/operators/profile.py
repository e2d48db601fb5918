"""Column and frame profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperlens.functions.columns import (
    clean_sql,
    double_sql,
    is_floating,
    is_numeric,
    long_form,
    present_columns,
    quoted,
    text_literal,
    unpivoted,
)
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.quantiles import grouped_quantiles
from tamperlens.plans.staging import stage

# fixed values: listing and review bounds
LISTED_VALUES = 20
REVIEW_UNIQUE = (5, 1000)
HIGH_RATING = 7


def _as_text(df: DataFrame, column: str) -> str:
    """SQL of the value as text; negative zero is the same value as zero."""
    zero = " + 0D" if is_floating(df.schema[column].dataType) else ""
    return f"cast({clean_sql(df, column)}{zero} AS STRING)"


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, dtype)."""
    listing = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(listing, "position int, column string, dtype string")


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value text, n) with NULL as one value; counted before any shuffle."""
    texts = df.selectExpr(*[f"{_as_text(df, c)} AS {quoted(c)}" for c in columns])
    cells = unpivoted(texts, columns, [], "value")
    return cells.groupBy("column", "value").agg(F.expr("count(*) AS n"))


def _counted_type(data_type: T.DataType) -> str | None:
    """Type whose values differ just where the texts of ``data_type`` do; None counts texts."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if is_floating(data_type):
        return "double"
    if isinstance(data_type, (T.DateType, T.TimestampNTZType)):
        return data_type.simpleString()
    return None


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str | None, DataFrame]:
    """(column, value, n) of the columns by ``_counted_type``; numbers are not written as texts."""
    kinds: dict[str | None, list[str]] = {}
    for c in columns:
        kinds.setdefault(_counted_type(df.schema[c].dataType), []).append(c)
    found = {}
    for kind, named in kinds.items():
        if kind is None:
            found[kind] = _value_counts(df, named)
            continue
        zero = " + 0D" if kind == "double" else ""
        values = df.selectExpr(*[f"cast({clean_sql(df, c)} AS {kind}){zero} AS {quoted(c)}" for c in named])
        cells = unpivoted(values, named, [], "value")
        found[kind] = cells.groupBy("column", "value").agg(F.expr("count(*) AS n"))
    return found


def listed_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = LISTED_VALUES) -> DataFrame:
    """(column, values, is_sampled): all distinct values up to n, else n of them.

    The choice goes by hash, so it is repeatable; every task keeps its n best per
    column before the shuffle.
    """
    columns = list(df.columns) if columns is None else present_columns(df, columns)
    counts = _value_counts(df, columns)
    unique = counts.groupBy("column").agg(F.count("*").alias("_unique"))
    pick = "row_number() OVER (PARTITION BY `column` ORDER BY xxhash64(value), value)"
    chosen = (
        counts.selectExpr("*", f"{pick} AS _r")
        .filter(f"_r <= {n}")
        .groupBy("column")
        .agg(
            F.expr(
                "transform(sort_array(collect_list(struct(value))), s -> coalesce(s.value, 'nan')) "
                "AS values"
            )
        )
    )
    return chosen.join(unique, "column").selectExpr(
        "`column`", "values", f"_unique > {n} AS is_sampled"
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, std): one row of aggregates over the table as it lies, then turned."""
    doubles = df.selectExpr(*[f"{double_sql(df, c)} AS c{i}" for i, c in enumerate(columns)])
    kinds = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp"}
    row = doubles.agg(
        *[F.expr(f"{fn}(c{i}) AS {name}{i}") for i in range(len(columns)) for name, fn in kinds.items()]
    )
    entries = [
        f"struct({text_literal(c)} AS column, {', '.join(f'{name}{i} AS {name}' for name in kinds)})"
        for i, c in enumerate(columns)
    ]
    return row.selectExpr(f"inline(array({', '.join(entries)}))")


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    with_values: bool = False,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Distinct counts of every column, moments and median of numeric ones.

    A missing value counts as one distinct value.  ``with_values`` adds the
    ``values`` and ``is_sampled`` of ``listed_values``.
    """
    columns = list(df.columns) if columns is None else present_columns(df, columns)
    if with_values:
        plain = column_profile(df, columns, limits=limits)
        return plain.join(listed_values(df, columns), "column", "left")
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    by_kind = _distinct_counts(df, columns)
    # the values of numbers are met again for the medians, decimals and booleans apart
    by_kind.update({kind: stage(by_kind[kind]) for kind in ("bigint", "double") if kind in by_kind})
    counts = reduce(
        DataFrame.unionAll,
        [
            values.groupBy("column").agg(
                F.expr("count(*) AS unique_count"),
                F.expr("sum(n) AS total_count"),
                F.expr("coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0L) AS non_null_count"),
            )
            for values in by_kind.values()
        ],
    )
    names = ", ".join(text_literal(c) for c in numeric)
    kinds = schema_table(df.selectExpr(*[quoted(c) for c in columns])).selectExpr(
        "`column`", "dtype", f"array_contains(array({names}), `column`) AS is_numeric" if numeric else "false AS is_numeric"
    )
    counted = [f"coalesce({c}, 0L) AS {c}" for c in ("unique_count", "total_count", "non_null_count")]
    profile = (
        kinds.join(counts, "column", "left")
        .selectExpr("`column`", "dtype", "is_numeric", *counted)
        .selectExpr("*", "unique_count / nullif(non_null_count, 0L) AS uniqueness_ratio")
    )
    if not numeric:
        empty = [f"cast(NULL AS DOUBLE) AS {c}" for c in ("min", "max", "mean", "median", "std")]
        return profile.selectExpr("*", *empty)
    stats = _moments(df, numeric)
    valued = [
        values.selectExpr("`column`", "cast(value AS DOUBLE) AS value", "n")
        for kind, values in by_kind.items()
        if kind in ("bigint", "double")
    ]
    others = [c for c in numeric if _counted_type(df.schema[c].dataType) is None]
    if others:
        valued.append(long_form(df, others).selectExpr("`column`", "value", "1L AS n"))
    largest = df.count()  # answered from file footers when df is a plain scan
    medians = grouped_quantiles(
        reduce(DataFrame.unionAll, valued), ["column"], "value", {"median": 0.5}, largest, limits, "n"
    )
    return profile.join(stats, "column", "left").join(medians, "column", "left").select(
        *profile.columns, "min", "max", "mean", "median", "std"
    )


def review_candidates(profile: DataFrame) -> DataFrame:
    """Columns with a number of distinct values worth reading."""
    return profile.filter(F.col("unique_count").between(*REVIEW_UNIQUE))


def suspicious_columns(ratings: DataFrame) -> DataFrame:
    """(column, rating, unique_count) rated high, highest first."""
    return (
        ratings.filter(F.col("suspicion_rating") >= HIGH_RATING)
        .select("column", F.col("suspicion_rating").alias("rating"), "unique_count")
        .orderBy(F.desc("rating"), "column")
    )


def suspicion_summary(ratings: DataFrame) -> DataFrame:
    """One row; a column without a rating counts as zero."""
    rated = F.coalesce(F.col("suspicion_rating"), F.lit(0))
    return ratings.agg(
        F.count("*").alias("total_columns_analyzed"),
        F.count_if(F.col("suspicion_rating") >= HIGH_RATING).alias("suspicious_columns"),
        F.avg(rated).alias("average_suspicion"),
    )


def frame_profile(df: DataFrame) -> DataFrame:
    """(position, column, dtype, null_count, row_count, column_count)."""
    counted = [f"count_if({clean_sql(df, c)} IS NULL) AS c{i}" for i, c in enumerate(df.columns)]
    nulls = df.agg(F.expr("count(*) AS _rows"), *[F.expr(c) for c in counted])
    entries = [
        f"struct({i} AS position, {text_literal(f.name)} AS column, "
        f"{text_literal(f.dataType.simpleString())} AS dtype, c{i} AS null_count, "
        f"_rows AS row_count, {len(df.columns)} AS column_count)"
        for i, f in enumerate(df.schema.fields)
    ]
    return nulls.selectExpr(f"inline(array({', '.join(entries)}))")
