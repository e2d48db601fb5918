"""Windows over positions that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.plans.limits import Limits
from tamperlens.plans.staging import partition_by, stage


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; one column-pruned, map-side combined count."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def fits_window(
    df: DataFrame, keys: Sequence[str], limits: Limits, strategy: str, total: int | None = None
) -> bool:
    """Whether every group fits a plain window; ``total`` rows of all groups, where known, may say so."""
    if strategy not in ("auto", "window", "blocked"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "auto" and total is not None and total <= limits.window_rows:
        return True
    if strategy == "auto":
        return largest_group(df, keys) <= limits.window_rows
    return strategy == "window"


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    block_rows: int | None,
    inside: Callable[[str], Mapping[str, str]] | None = None,
    along: Callable[[str], Mapping[str, str]] | None = None,
) -> DataFrame:
    """0-based position inside ``keys`` by the dense BIGINT ``order`` column.

    With ``block_rows`` the rows are numbered inside (keys, block of order) and
    the block counts are summed up; without it a plain window numbers the group.
    ``inside`` names further columns over the window of the blocks, which takes no second sort,
    and ``along`` columns over all rows of a block of the order, whatever their group. With
    ``along`` rows whose keys are NULL form groups as well; else they are left out.
    """
    if block_rows is None:
        ranked = f"row_number() OVER ({partition_by(keys)} ORDER BY {quoted(order)})"
        return df.withColumn(out, F.expr(f"cast({ranked} AS BIGINT) - 1"))
    blocked = df.withColumn("_ob", F.expr(f"{quoted(order)} div {block_rows}L"))
    counts = blocked.groupBy(*keys, "_ob").agg(F.count("*").alias("_cnt"))
    bases = counts.selectExpr(
        *[quoted(k) for k in keys],
        "_ob",
        f"coalesce(sum(_cnt) OVER ({partition_by(keys)} ORDER BY _ob "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _base",
    )
    def named(columns, window: str) -> list[str]:
        return [f"{sql} AS {quoted(name)}" for name, sql in (columns(window) if columns else {}).items()]

    on = [*keys, "_ob"]
    if along:
        # all windows lie inside blocks of the order, so one shuffle by block serves them
        blocked = blocked.selectExpr("*", *named(along, f"PARTITION BY _ob ORDER BY {quoted(order)}"))
        # staged, so that Catalyst knows its size before the rows are shuffled for a join
        bases = stage(bases).selectExpr("_base", *[f"{quoted(k)} AS {quoted('_b' + k)}" for k in on])
        on = F.expr(" AND ".join(f"{quoted(k)} <=> {quoted('_b' + k)}" for k in on))
    window = f"{partition_by([*keys, '_ob'])} ORDER BY {quoted(order)}"
    return (
        blocked.selectExpr("*", f"row_number() OVER ({window}) - 1 AS _local", *named(inside, window))
        .join(bases, on)
        .withColumn(out, F.expr("cast(_base + _local AS BIGINT)"))
        .drop("_ob", "_local", "_base", *[f"_b{k}" for k in [*keys, "_ob"]])
    )


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    reach: int,
    columns: Callable[[str], Mapping[str, str]],
    block_rows: int | None,
) -> DataFrame:
    """Add window columns that look at most ``reach`` positions away.

    ``columns`` receives the PARTITION BY and ORDER BY of the window and names
    the SQL of each new column.  With ``block_rows`` each block of positions gets
    copies of the ``reach`` rows on either side of it; the copies leave again
    after the window ran.
    """
    at = quoted(position)

    def extended(frame: DataFrame, window: str) -> DataFrame:
        new = [f"{sql} AS {quoted(name)}" for name, sql in columns(window).items()]
        return frame.selectExpr("*", *new)

    if block_rows is None:
        return extended(df, f"{partition_by(keys)} ORDER BY {at}")
    size = max(block_rows, reach + 1)
    touched = (
        f"array_distinct(array(greatest({at} - {reach}, 0L) div {size}L, {at} div {size}L, "
        f"({at} + {reach}) div {size}L))"
    )
    copies = df.withColumn("_pb", F.explode(F.expr(touched)))
    seen = extended(copies, f"{partition_by([*keys, '_pb'])} ORDER BY {at}")
    return seen.filter(f"_pb = {at} div {size}L").drop("_pb")


def previous_row_value(df: DataFrame, row_id: str, value: str, out: str) -> DataFrame:
    """(row_id, out): ``value`` of the row just before, by equi-join key row_id."""
    return df.selectExpr(f"{quoted(row_id)} + 1 AS {quoted(row_id)}", f"{quoted(value)} AS {quoted(out)}")
