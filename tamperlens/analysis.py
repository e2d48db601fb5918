"""All checks over one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import numeric_columns, present_columns, quoted, require_columns
from tamperlens.operators.calcchain import row_movement
from tamperlens.operators.digits import keep_suspicious, terminal_digits
from tamperlens.operators.distribution import multimodality
from tamperlens.operators.effects import significance_change, suspicious_effects
from tamperlens.operators.inliers import inlier_bands
from tamperlens.operators.ordering import duplicate_ids, sorting_anomalies
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.staging import stage, with_row_id

# sheet rows before data row 0, counted from 1 on: the header row
HEADER_ROWS = 2


def analyze(
    df: DataFrame,
    id_col: str,
    group: str,
    outcomes: Sequence[str],
    order_by: Sequence[str | Column],
    chain: DataFrame | None = None,
    focus: Sequence[str] = (),
    limits: Limits = DEFAULT_LIMITS,
) -> dict[str, DataFrame]:
    """Findings per type; pass the result to ``findings_long`` or write each.

    Only the id, the group, the numeric columns and the order keys are numbered and
    written.  The row numbering and the ordering findings are staged once because
    the effect checks start from them; the other checks stay lazy.  With a ``chain``
    of several workbooks, ``df`` carries ``path`` and ``sheet_row`` as the workbook
    reader gives them, and its rows are looked for in their own workbook.
    """
    require_columns(df, [id_col, group])
    outcomes = present_columns(df, outcomes)
    place = [c for c in ("path", "sheet_row") if chain is not None and c in df.columns]
    needed = dict.fromkeys([id_col, group, *outcomes, *numeric_columns(df), *place])
    keys = [F.col(quoted(c)) if isinstance(c, str) else c for c in order_by]
    narrow = df.select(
        *[F.col(quoted(c)) for c in needed], *[k.alias(f"_order{i}") for i, k in enumerate(keys)]
    )
    numbered = with_row_id(narrow, [f"_order{i}" for i in range(len(keys))])
    numbered = numbered.drop(*[f"_order{i}" for i in range(len(keys))])
    located = numbered
    numbered = numbered.drop(*place)
    order = stage(
        sorting_anomalies(
            numbered, id_col, group, prioritize=[*focus, *outcomes], limits=limits
        )
    )
    results = {
        "sorting_anomaly": order,
        "effect_size_analysis": suspicious_effects(numbered, order, group, outcomes, limits=limits),
        "with_without_comparison": significance_change(numbered, order, group, outcomes),
        "duplicate_ids": duplicate_ids(numbered, id_col, limits=limits),
        "terminal_digit_anomaly": keep_suspicious(terminal_digits(numbered, outcomes)),
        "distribution_anomaly": keep_suspicious(
            multimodality(numbered, outcomes, group, limits=limits)
        ),
        "inlier_anomaly": keep_suspicious(inlier_bands(numbered, outcomes, group, limits=limits)),
    }
    if chain is not None:
        listed = order
        if len(place) == 2:
            listed = located.join(order.select("row_index").distinct(), F.col("row_id") == F.col("row_index")).selectExpr(
                "path", f"CAST(sheet_row - {HEADER_ROWS} AS BIGINT) AS row_index"
            )
        results["excel_row_movement"] = row_movement(chain, listed, limits=limits)
    return results
