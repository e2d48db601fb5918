"""Schema helpers, missing values and the long form used by column checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers, booleans and decimals count as numeric."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ``ValueError`` naming every column the frame lacks."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def missing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The asked-for columns that do not exist, in the order asked."""
    present = set(df.columns)
    return [c for c in columns if c not in present]


def present_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    kept = [c for c in columns if c in set(df.columns)]
    if not kept:
        raise ValueError("none of the named columns exist")
    return kept


def numeric_columns(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    prioritize: Sequence[str] = (),
) -> list[str]:
    """Numeric columns, ``prioritize`` first in the given order."""
    found = [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType)
        and f.name not in exclude
        and (include is None or f.name in include)
    ]
    if include is not None:
        found = [c for c in include if c in found]
    first = [c for c in prioritize if c in found]
    return first + [c for c in found if c not in first]


def quoted(column: str) -> str:
    """Column name for use inside a SQL expression."""
    return "`" + column.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """String literal for use inside a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean_sql(df: DataFrame, column: str) -> str:
    """The column with NaN turned into NULL, as SQL."""
    if is_floating(df.schema[column].dataType):
        return f"nullif({quoted(column)}, {df.schema[column].dataType.simpleString()}('NaN'))"
    return quoted(column)


def clean(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into NULL."""
    return F.expr(clean_sql(df, column))


def double_sql(df: DataFrame, column: str) -> str:
    """The column as DOUBLE with NaN turned into NULL, as SQL."""
    return f"cast({clean_sql(df, column)} AS DOUBLE)"


def normalize_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes NULL in every (named) floating column."""
    chosen = df.columns if columns is None else present_columns(df, columns)
    changes = {c: clean(df, c) for c in chosen if is_floating(df.schema[c].dataType)}
    return df.withColumns(changes) if changes else df


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str], value: str) -> DataFrame:
    """(keep…, column, value) of columns of one type, whatever characters their names have."""
    return df.unpivot(
        [F.col(quoted(c)) for c in keep], [F.col(quoted(c)) for c in columns], "column", value
    )


def long_form(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    value: str = "value",
    expression: Callable[[DataFrame, str], str] = double_sql,
) -> DataFrame:
    """(keep…, column, value): one row per cell, NULL cells left out, one scan.

    ``expression`` gives the SQL of one column's cell.
    """
    narrow = df.selectExpr(
        *[quoted(c) for c in keep], *[f"{expression(df, c)} AS {quoted(c)}" for c in columns]
    )
    cells = unpivoted(narrow, columns, keep, value)
    return cells.filter(f"{quoted(value)} IS NOT NULL")


def grouped_long(
    df: DataFrame, columns: Sequence[str], by: str | None, include_overall: bool = False
) -> DataFrame:
    """(column, group, value); group is NULL for the overall distribution.

    Rows with a NULL group belong to no group but do count overall.
    """
    if by is None:
        return long_form(df, columns).withColumn("group", F.lit(None).cast("string"))
    keyed = df.withColumn("_g", F.expr(f"cast({clean_sql(df, by)} AS STRING)"))
    if not include_overall:
        cells = long_form(keyed.filter("_g IS NOT NULL"), columns, ["_g"])
        return cells.withColumnRenamed("_g", "group")
    cells = long_form(keyed, columns, ["_g"])
    return cells.selectExpr(
        "`column`", "explode(array_distinct(array(cast(NULL AS STRING), _g))) AS `group`", "value"
    )


def group_map(names: Sequence[str], columns: Sequence[str]) -> Column:
    """Values of ``columns`` as MAP<STRING,STRING> under the given names."""
    entries = [
        f"{text_literal(name)}, cast({quoted(c)} AS STRING)" for name, c in zip(names, columns)
    ]
    return F.expr(f"map({', '.join(entries)})")


def group_label(names: Sequence[str], columns: Sequence[str]) -> Column:
    """Values of ``columns`` as ``name=value, name=value``."""
    parts = [
        f"concat({text_literal(name + '=')}, coalesce(cast({quoted(c)} AS STRING), 'nan'))"
        for name, c in zip(names, columns)
    ]
    return F.expr(f"concat_ws(', ', {', '.join(parts)})")
