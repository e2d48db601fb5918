"""Evidence tables behind charts, row previews and issue lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

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
from tamperlens.operators.effects import (
    FULL,
    WITHOUT,
    Rows,
    _flagged_cells,
    compare_with_without,
    descriptive_stats,
)
from tamperlens.operators.rows import flag_rows, rows_frame
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.quantiles import grouped_quantiles
from tamperlens.plans.staging import BLOCK, SEQ, previous_in_order, stage, stage_keys, with_row_id

# fixed values: preview and chart bounds
CONTEXT, HEAD = 2, 5
OUTLIER_Z = 3.0
RANGE_STEP = 1000
WHISKER = 1.5


# --- chart data -----------------------------------------------------------


def id_sequence(
    df: DataFrame, id_col: str, group: str, rows: Rows, row_id: str = "row_id"
) -> DataFrame:
    """(row_number, id_value, group, is_suspicious) for every row."""
    require_columns(df, [id_col, group, row_id])
    narrow = df.selectExpr(
        f"{quoted(row_id)} AS row_number",
        f"{quoted(id_col)} AS id_value",
        f"cast({quoted(group)} AS STRING) AS `group`",
    )
    return flag_rows(narrow, rows, "row_number")


def suspicious_vs_normal(
    df: DataFrame, rows: Rows, group: str, outcomes: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """Mean and count per outcome, side and group."""
    cells = _flagged_cells(df, rows, group, outcomes, row_id)
    named = cells.selectExpr("`column` AS outcome", "is_suspicious", "_g AS `group`", "value")
    return named.groupBy("outcome", "is_suspicious", "group").agg(
        F.expr("avg(value) AS mean"), F.expr("count(*) AS n")
    )


def box_summary(
    df: DataFrame,
    rows: Rows,
    group: str,
    outcomes: Sequence[str],
    row_id: str = "row_id",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Quartiles and whiskers per outcome, side and group.

    A whisker ends at the last value within 1.5 interquartile ranges of the box.
    """
    cells = _flagged_cells(df, rows, group, outcomes, row_id)
    keys = ["column", "is_suspicious", "_g"]
    counts, sizes = stage_keys(cells.groupBy(*keys).agg(F.count("*").alias("n")), "n")
    quartiles = grouped_quantiles(
        cells, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, sizes.largest, limits
    )
    boxes = stage(counts.join(quartiles, keys))
    inside = f"value BETWEEN q1 - {WHISKER}D * (q3 - q1) AND q3 + {WHISKER}D * (q3 - q1)"
    fenced = (
        attach_by_key(cells, boxes, keys, "n", limits, sizes)
        .groupBy(*keys)
        .agg(
            F.expr(f"min(value) FILTER (WHERE {inside}) AS whisker_low"),
            F.expr(f"max(value) FILTER (WHERE {inside}) AS whisker_high"),
            F.expr(f"count_if(NOT ({inside})) AS outside"),
        )
    )
    return boxes.join(fenced, keys).selectExpr(
        "`column` AS outcome",
        "is_suspicious",
        "_g AS `group`",
        "n",
        "q1",
        "median",
        "q3",
        "whisker_low",
        "whisker_high",
        "outside",
    )


def effect_size_table(
    df: DataFrame, rows: Rows, group: str, outcomes: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """I4: (outcome, group, against, place, effect_size_type, effect_size).

    Groups are placed by their first suspicious row; each later group is measured
    against the first.  An outcome without values on one of the four sides of a
    pair is left out.
    """
    names = numeric_columns(df, present_columns(df, outcomes))
    listed = rows_frame(df.sparkSession, rows)
    keyed = df.selectExpr(f"{quoted(row_id)} AS row_index", f"cast({clean_sql(df, group)} AS STRING) AS _g")
    seen = stage(
        keyed.filter("_g IS NOT NULL")
        .join(listed, "row_index", "left_semi")
        .groupBy("_g")
        .agg(F.expr("min(row_index) AS first_row"))
    )
    # one row per group
    placed = with_row_id(seen, ["first_row"], "place").selectExpr("_g", "CAST(place + 1 AS INT) AS place")
    aggregates = [
        F.expr(f"{fn}(value) FILTER (WHERE {test}) AS {short}_b{flag}")
        for flag, test in (("s", "is_suspicious"), ("n", "NOT is_suspicious"))
        for short, fn in (("n", "count"), ("m", "avg"), ("v", "var_samp"))
    ]
    per_group = stage(
        _flagged_cells(df, listed, group, names, row_id).groupBy("column", "_g").agg(*aggregates).join(placed, "_g")
    )
    sums = [f"{short}_b{flag}" for flag in "sn" for short in "nmv"]
    first = per_group.filter("place = 1").selectExpr(
        "`column`", "_g AS against", *[f"{c} AS {c.replace('_b', '_a')}" for c in sums]
    )
    # a row for each table column
    stats = per_group.filter("place > 1").join(F.broadcast(first), "column")
    full = " AND ".join(f"n_{side}{flag} >= 1" for side in "ab" for flag in "sn")

    def raw(f: str) -> str:
        return f"abs(m_a{f} - m_b{f})"

    def cohen(f: str) -> str:
        pooled = (
            f"sqrt(((n_a{f} - 1) * v_a{f} + (n_b{f} - 1) * v_b{f}) / nullif(n_a{f} + n_b{f} - 2, 0L))"
        )
        d = f"(m_a{f} - m_b{f}) / nullif({pooled}, 0D)"
        return f"coalesce(if(n_a{f} > 1 AND n_b{f} > 1, {d}, NULL), 0D)"

    entries = {
        "Raw Difference (Suspicious)": raw("s"),
        "Raw Difference (Normal)": raw("n"),
        "Cohen's d (Suspicious)": cohen("s"),
        "Cohen's d (Normal)": cohen("n"),
    }
    bars = ", ".join(
        f"struct({text_literal(name)} AS effect_size_type, {sql} AS effect_size)"
        for name, sql in entries.items()
    )
    return stats.filter(full).selectExpr(
        "`column` AS outcome", "_g AS `group`", "against", "place", f"inline(array({bars}))"
    )


def with_without_chart(
    df: DataFrame,
    rows: Rows,
    group: str,
    outcomes: Sequence[str],
    row_id: str = "row_id",
    against: str | None = None,
    all_pairs: bool = False,
) -> DataFrame:
    """Bars of the with/without chart, pairs as in ``compare_with_without``.

    ``measure`` is ``mean`` (label group, spread deviation), ``effect_size`` or
    ``p_value_x100`` (label pair).
    """
    listed = rows_frame(df.sparkSession, rows)
    shown = f"scope IN ('{FULL}', '{WITHOUT}')"
    means = descriptive_stats(df, listed, group, outcomes, row_id).filter(shown).selectExpr(
        "outcome", "scope", "'mean' AS measure", "`group` AS label", "mean AS value", "std AS spread"
    )
    pairs = compare_with_without(df, listed, group, outcomes, row_id, against, all_pairs).filter(
        f"{shown} AND error IS NULL"
    )
    bars = (
        "inline(array(struct('effect_size' AS measure, cohens_d AS value), "
        "struct('p_value_x100' AS measure, p_value * 100 AS value)))"
    )
    tests = pairs.selectExpr("outcome", "scope", "pair AS label", bars)
    return means.unionByName(tests.withColumn("spread", F.expr("cast(NULL AS DOUBLE)")))


# --- outliers and preview rows --------------------------------------------


def zscore_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    row_id: str = "row_id",
    threshold: float = OUTLIER_Z,
) -> DataFrame:
    """(row_index, column, value, z_score, threshold) beyond the threshold."""
    chosen = df.columns if columns is None else present_columns(df, columns)
    names = [c for c in numeric_columns(df, chosen) if c != row_id]
    cells = long_form(df, names, [row_id])
    stats = cells.groupBy("column").agg(
        F.expr("avg(value) AS _mean"), F.expr("nullif(stddev_samp(value), 0D) AS _std")
    )
    # one row per table column: the schema bounds this broadcast
    return (
        cells.join(F.broadcast(stats), "column")
        .selectExpr("*", "(value - _mean) / _std AS z_score")
        .filter(f"abs(z_score) > {threshold}")
        .selectExpr(f"{quoted(row_id)} AS row_index", "`column`", "value", "z_score", f"{float(threshold)}D AS threshold")
    )


def context_rows(
    df: DataFrame,
    rows: Rows,
    reach: int = CONTEXT,
    head: int = HEAD,
    row_id: str = "row_id",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """I8: suspicious rows with their neighbours and the first rows of the file.

    ``omitted_before`` counts the rows hidden since the preceding shown row.
    """
    listed = rows_frame(df.sparkSession, rows)
    name = quoted(row_id)
    around = f"explode(sequence(greatest(row_index - {reach}, 0L), row_index + {reach})) AS {name}"
    first = df.sparkSession.range(head).selectExpr(f"id AS {name}")
    wanted = listed.selectExpr(around).union(first).distinct()
    marks = listed.selectExpr(f"row_index AS {name}", "true AS is_suspicious")
    shown = (
        df.join(wanted, row_id, "left_semi")
        .join(marks, row_id, "left")
        # blocks of row numbers stand in for a sort: one block never outgrows its rows
        .selectExpr(
            *[quoted(c) for c in df.columns],
            "coalesce(is_suspicious, false) AS is_suspicious",
            f"{name} div {limits.block_rows}L AS {BLOCK}",
            f"{name} AS {SEQ}",
        )
    )
    # staged, because the block edges and the rows both read it
    ordered = previous_in_order(stage(shown), [], row_id, "_before")
    omitted = f"coalesce({name} - _before - 1, 0L) AS omitted_before"
    return ordered.selectExpr("*", omitted).drop(BLOCK, SEQ, "_before")


def context_totals(df: DataFrame, shown: DataFrame) -> DataFrame:
    """I8: one row with the displayed and the skipped row count."""
    total = df.agg(F.count("*")).scalar()
    return shown.agg(F.count("*").alias("displayed_rows")).select(
        "displayed_rows", (total - F.col("displayed_rows")).alias("skipped_rows")
    )


def segment_range_rows(
    df: DataFrame, indices: str | None = None, rows: str | None = None, out: str = "row_index"
) -> DataFrame:
    """One row per row number named by a segment finding.

    ``indices`` is text, a JSON list or a single number; where it gives nothing,
    all rows of the range ``rows`` ("100-200", both ends) stand in.
    """
    none = F.lit(None).cast("array<bigint>")
    named = none
    if indices is not None:
        text = F.trim(F.col(indices))
        as_list = F.filter(
            F.transform(F.from_json(text, "array<string>"), lambda v: v.try_cast("bigint")),
            lambda v: v.isNotNull(),
        )
        single = F.array_compact(F.array(text.try_cast("bigint")))
        chosen = F.when(F.startswith(text, F.lit("[")), as_list).otherwise(single)
        named = F.when(F.size(chosen) > 0, chosen)
    if rows is None:
        return df.withColumn(out, F.explode(named))
    start = F.regexp_extract(rows, r"^(\d+)-(\d+)", 1).try_cast("bigint")
    end = F.regexp_extract(rows, r"^(\d+)-(\d+)", 2).try_cast("bigint")
    # long ranges unfold in steps, so that no array holds a whole range
    steps = F.when(named.isNull() & (start <= end), F.sequence(start, end, F.lit(RANGE_STEP).cast("bigint")))
    first = F.explode(F.coalesce(steps, F.when(named.isNotNull(), F.array(F.lit(0).cast("bigint")))))
    unfolded = F.coalesce(named, F.sequence(F.col("_from"), F.least(F.col("_from") + (RANGE_STEP - 1), end)))
    return df.withColumn("_from", first).withColumn(out, F.explode(unfolded)).drop("_from")


# --- issue lists ----------------------------------------------------------

ISSUE_COLUMNS = (
    "row_index",
    "issue_type",
    "finding_type",
    "explanation",
    "column",
    "cell_type",
    "cell_explanation",
    "seq",
)


def _issue(df: DataFrame, rank: int, within: Column, tie: Column, **columns: Column) -> DataFrame:
    """Issue rows in the common form; ``seq`` is the order findings are applied in."""
    seq = F.struct(
        F.lit(rank).alias("rank"), within.cast("bigint").alias("within"), tie.cast("string").alias("tie")
    )
    missing = {c: F.lit(None).cast("string") for c in ISSUE_COLUMNS[4:7] if c not in columns}
    values = {**columns, **missing, "seq": seq}
    return df.select(*[values[c].alias(c) for c in ISSUE_COLUMNS])


def _join_text(*parts: Column | str) -> Column:
    shown = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(*shown)


def issues_from_sorting(findings: DataFrame, id_column: str | None = None) -> DataFrame:
    """Issues of ``sorting_anomalies`` rows; duplicates across groups count as sorting."""
    ident, before = F.col("id_value"), F.col("previous_id")
    return _issue(
        findings,
        1,
        -F.col("severity"),
        F.col("type"),
        row_index=F.col("row_index"),
        issue_type=F.lit("sorting_anomaly"),
        finding_type=F.col("type"),
        explanation=_join_text("id ", ident, " follows id ", before, " in ", F.col("group_label")),
        column=F.lit(id_column).cast("string"),
        cell_type=F.lit("sorting"),
        cell_explanation=_join_text(ident, " off its place, after ", before),
    )


def issues_from_movement(movement: DataFrame) -> DataFrame:
    """Issues of ``row_movement`` rows; they mark rows, not cells."""
    return _issue(
        movement,
        2,
        F.lit(0),
        F.col("path"),
        row_index=F.col("data_row_index"),
        issue_type=F.lit("excel_movement"),
        finding_type=F.lit("excel_row_movement"),
        explanation=F.coalesce("explanation", F.lit("the row was moved")),
    )


def issues_from_duplicates(rows: DataFrame, id_column: str | None = None) -> DataFrame:
    """Issues of ``duplicate_id_rows``."""
    text = _join_text("id ", F.col("id_value"), " stands in ", F.col("count"), " rows")
    return _issue(
        rows,
        3,
        F.lit(0),
        F.col("id_value"),
        row_index=F.col("row_index"),
        issue_type=F.lit("duplicate_id"),
        finding_type=F.lit("duplicate_ids"),
        explanation=text,
        column=F.lit(id_column).cast("string"),
        cell_type=F.lit("duplicate"),
        cell_explanation=text,
    )


def issues_from_outliers(outliers: DataFrame) -> DataFrame:
    """Issues of ``zscore_outliers`` rows, which carry the threshold they passed."""
    bound = F.concat(F.lit("z-score beyond "), F.col("threshold").cast("string"))
    return _issue(
        outliers,
        4,
        F.lit(0),
        F.col("column"),
        row_index=F.col("row_index"),
        issue_type=F.lit("statistical_anomaly"),
        finding_type=F.lit("statistical_anomaly"),
        explanation=_join_text(F.col("column"), ": ", bound),
        column=F.col("column"),
        cell_type=F.lit("outlier"),
        cell_explanation=bound,
    )


def issues_from_segments(findings: DataFrame, default_column: str | None = None) -> DataFrame:
    """Issues of segment findings (row_index, description, columns_involved, severity).

    Each involved column is marked, or ``default_column`` when none is named.
    """
    named = F.coalesce("columns_involved", F.array(F.lit("unknown")))
    marked = F.when(F.size("columns_involved") > 0, F.col("columns_involved")).otherwise(
        F.array(F.lit(default_column).cast("string"))
    )
    text = _join_text(
        F.coalesce("description", F.lit("no description")),
        " [columns ",
        F.array_join(named, ", "),
        "; severity ",
        F.coalesce(F.col("severity").cast("string"), F.lit("unknown")),
        "]",
    )
    cells = findings.withColumn("_text", text).withColumn("_marked", F.explode_outer(marked))
    return _issue(
        cells,
        5,
        F.lit(0),
        F.col("_text"),
        row_index=F.col("row_index"),
        issue_type=F.lit("segment_anomaly"),
        finding_type=F.lit("segment_anomaly"),
        explanation=F.col("_text"),
        column=F.col("_marked"),
        cell_type=F.lit("segment_anomaly"),
        cell_explanation=F.coalesce("description", F.lit("no description")),
    )


def _union(issues: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def row_issues(*issues: DataFrame) -> DataFrame:
    """One row per (row, issue type) with its first explanation, in row order."""
    return (
        _union(issues)
        .groupBy("row_index", "issue_type")
        .agg(
            F.min_by("explanation", "seq").alias("explanation"),
            F.min_by("finding_type", "seq").alias("finding_type"),
        )
        .orderBy("row_index", "issue_type")
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Rows per issue type."""
    return issues.groupBy("issue_type").agg(F.count("*").alias("rows"))


def cell_highlights(*issues: DataFrame) -> DataFrame:
    """One row per marked cell with the highlight written last."""
    return (
        _union(issues)
        .filter(F.col("column").isNotNull())
        .groupBy("row_index", "column")
        .agg(
            F.max_by("cell_type", "seq").alias("cell_type"),
            F.max_by("cell_explanation", "seq").alias("explanation"),
        )
    )
