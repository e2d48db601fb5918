"""Chart data, preview rows, issue lists and the findings summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    CUSTOMER_ORDER,
    EVENTS_ORDER,
    SQL_CUSTOMER,
    SQL_EVENTS,
    events,
    numbered,
    round_rows,
    rounded,
    sql_round,
    table,
)
from catalog.effect_queries import _BASE as SQL_EFFECTS
from catalog.effect_queries import _TESTED as SQL_TESTED
from catalog.ordering_queries import _NAME_SEQUENCE
from tamperlens.analysis import analyze
from tamperlens.operators.evidence import (
    box_summary,
    cell_highlights,
    context_rows,
    context_totals,
    effect_size_table,
    id_sequence,
    issue_counts,
    issues_from_duplicates,
    issues_from_outliers,
    issues_from_segments,
    issues_from_sorting,
    row_issues,
    segment_range_rows,
    suspicious_vs_normal,
    with_without_chart,
    zscore_outliers,
)
from tamperlens.operators.findings import findings_long, findings_summary
from tamperlens.operators.ordering import duplicate_id_rows, out_of_sequence_ids

OUTCOMES = ["value", "user_id"]


def _inputs(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows, round_rows(rows), "event_type", OUTCOMES


def sequence(spark, sf_dir):
    rows = events(spark, sf_dir)
    return id_sequence(rows, "event_id", "event_type", round_rows(rows))


def side_means(spark, sf_dir):
    return rounded(suspicious_vs_normal(*_inputs(spark, sf_dir)))


def boxes(spark, sf_dir):
    return rounded(box_summary(*_inputs(spark, sf_dir)))


def effect_bars(spark, sf_dir):
    return rounded(effect_size_table(*_inputs(spark, sf_dir)))


def chart_bars(spark, sf_dir):
    found = with_without_chart(*_inputs(spark, sf_dir), all_pairs=True)
    return rounded(found.filter("measure <> 'p_value_x100'"))


def chart_p_values(spark, sf_dir):
    return rounded(with_without_chart(*_inputs(spark, sf_dir), all_pairs=True).filter("measure = 'p_value_x100'"), 4)


def outliers(spark, sf_dir):
    return rounded(zscore_outliers(events(spark, sf_dir), OUTCOMES))


def preview(spark, sf_dir):
    rows = events(spark, sf_dir)
    shown = context_rows(rows, round_rows(rows))
    return shown.select("row_id", "event_id", "value", "is_suspicious", "omitted_before")


def preview_totals(spark, sf_dir):
    rows = events(spark, sf_dir)
    return context_totals(rows, context_rows(rows, round_rows(rows)))


def named_rows(spark, sf_dir):
    """Row references as text: a JSON list, a single number, or only a range."""
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(', "3", "x"]')),
        )
        .when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string"))
        .alias("indices"),
        F.concat(
            F.col("o_custkey").cast("string"),
            F.lit("-"),
            (F.col("o_custkey") + F.length("o_orderpriority")).cast("string"),
        ).alias("rows"),
    )
    return segment_range_rows(source, "indices", "rows").select("o_orderkey", "row_index")


def _customer_issues(spark, sf_dir):
    """Misplaced names, repeated balances and outlying balances of the customers."""
    rows = numbered(spark, sf_dir, "customer", CUSTOMER_ORDER, "c_name", "c_mktsegment", "c_nationkey")
    misplaced = out_of_sequence_ids(rows, "c_name", "c_mktsegment")
    repeated = duplicate_id_rows(rows, "c_acctbal")
    far = zscore_outliers(rows, ["c_acctbal"], threshold=1.7)
    segments = rows.filter("c_acctbal < 0").select(
        F.col("row_id").alias("row_index"),
        F.lit("negative balance").alias("description"),
        F.array(F.lit("c_acctbal"), F.lit("c_name")).alias("columns_involved"),
        F.lit("6").alias("severity"),
    )
    return (
        issues_from_sorting(misplaced, "c_name"),
        issues_from_duplicates(repeated, "c_acctbal"),
        issues_from_outliers(far),
        issues_from_segments(segments),
    )


def customer_issues(spark, sf_dir):
    return row_issues(*_customer_issues(spark, sf_dir))


def customer_issue_counts(spark, sf_dir):
    return issue_counts(row_issues(*_customer_issues(spark, sf_dir)))


def customer_cells(spark, sf_dir):
    return cell_highlights(*_customer_issues(spark, sf_dir))


def summary(spark, sf_dir):
    rows = numbered(spark, sf_dir, "customer", CUSTOMER_ORDER, "c_name", "c_mktsegment", "c_nationkey")
    return findings_summary(
        findings_long(
            {
                "sorting_anomaly": out_of_sequence_ids(rows, "c_name", "c_mktsegment"),
                "duplicate_ids": duplicate_id_rows(rows, "c_acctbal"),
                "statistical_anomaly": zscore_outliers(rows, ["c_acctbal"], threshold=1.7),
            }
        )
    )


def whole_analysis(spark, sf_dir):
    """Every check over the events, ids out of file order because users repeat."""
    source = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    results = analyze(source, "user_id", "event_type", ["value"], EVENTS_ORDER)
    return findings_summary(findings_long(results))


QUERIES = {
    "id_sequence": sequence,
    "suspicious_vs_normal": side_means,
    "box_summary": boxes,
    "effect_size_table": effect_bars,
    "with_without_chart": chart_bars,
    "with_without_chart_p_values": chart_p_values,
    "zscore_outliers": outliers,
    "context_rows": preview,
    "context_totals": preview_totals,
    "segment_range_rows": named_rows,
    "row_issues": customer_issues,
    "issue_counts": customer_issue_counts,
    "cell_highlights": customer_cells,
    "findings_summary": summary,
    "analyze": whole_analysis,
}

_CONTEXT = f"""
        base AS ({SQL_EVENTS}),
        wanted AS (
            SELECT unnest(range(greatest(row_id - 2, 0), row_id + 3)) AS row_id FROM base
            WHERE value = floor(value)
            UNION SELECT unnest(range(0, 5))),
        shown AS (
            SELECT base.row_id, event_id, value, value = floor(value) AS is_suspicious,
                coalesce(base.row_id - lag(base.row_id) OVER (ORDER BY base.row_id) - 1, 0) AS omitted_before
            FROM base JOIN wanted USING (row_id))"""

_ISSUES = f"""
        {_NAME_SEQUENCE},
        stats AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM numbered),
        repeats AS (SELECT row_id, c_acctbal, count(*) OVER (PARTITION BY c_acctbal) AS n FROM numbered),
        far AS (SELECT row_id FROM numbered, stats WHERE abs((c_acctbal - m) / s) > 1.7),
        issues AS (
            SELECT row_index, 'sorting_anomaly' AS issue_type, 'out_of_sequence_id' AS finding_type,
                'id ' || id_value || ' follows id ' || coalesce(previous_id, 'None')
                    || ' in ' || group_label AS explanation,
                'c_name' AS "column", 'sorting' AS cell_type,
                id_value || ' off its place, after ' || coalesce(previous_id, 'None')
                    AS cell, 1 AS rank
            FROM found
            UNION ALL
            SELECT row_id, 'duplicate_id', 'duplicate_ids',
                'id ' || c_acctbal || ' stands in ' || n || ' rows', 'c_acctbal', 'duplicate',
                'id ' || c_acctbal || ' stands in ' || n || ' rows', 3
            FROM repeats WHERE n > 1
            UNION ALL
            SELECT row_id, 'statistical_anomaly', 'statistical_anomaly',
                'c_acctbal: z-score beyond 1.7', 'c_acctbal', 'outlier', 'z-score beyond 1.7', 4 FROM far
            UNION ALL
            SELECT row_id, 'segment_anomaly', 'segment_anomaly',
                'negative balance [columns c_acctbal, c_name; severity 6]', c, 'segment_anomaly',
                'negative balance', 5
            FROM numbered CROSS JOIN (VALUES ('c_acctbal'), ('c_name')) t(c) WHERE c_acctbal < 0),
        rows_ AS (
            SELECT row_index, issue_type, arg_min(explanation, rank) AS explanation,
                arg_min(finding_type, rank) AS finding_type
            FROM issues GROUP BY row_index, issue_type)"""

SQL = {
    "id_sequence": f"""
        SELECT row_id AS row_number, event_id AS id_value, event_type AS "group",
            value = floor(value) AS is_suspicious FROM ({SQL_EVENTS})""",
    "suspicious_vs_normal": f"""
        WITH {SQL_EFFECTS}
        SELECT outcome, s AS is_suspicious, g AS "group", {sql_round("avg(value)", "mean")}, count(*) AS n
        FROM cells GROUP BY ALL""",
    "box_summary": f"""
        WITH {SQL_EFFECTS},
        boxes AS (
            SELECT outcome, s, g, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS q2,
                quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY ALL),
        fenced AS (
            SELECT c.*, n, q1, q2, q3,
                value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
            FROM cells c JOIN boxes b ON c.outcome = b.outcome AND c.s = b.s AND c.g = b.g)
        SELECT outcome, s AS is_suspicious, g AS "group", any_value(n) AS n,
            {sql_round("any_value(q1)", "q1")}, {sql_round("any_value(q2)", "median")},
            {sql_round("any_value(q3)", "q3")},
            {sql_round("min(value) FILTER (WHERE inside)", "whisker_low")},
            {sql_round("max(value) FILTER (WHERE inside)", "whisker_high")},
            count(*) FILTER (WHERE NOT inside) AS outside
        FROM fenced GROUP BY outcome, s, g""",
    "effect_size_table": f"""
        WITH {SQL_EFFECTS},
        places AS (SELECT g, row_number() OVER (ORDER BY min(row_id)) AS k FROM cells WHERE s GROUP BY g),
        sums AS (
            SELECT outcome, s, g, k, count(*) AS n, avg(value) AS m, var_samp(value) AS v
            FROM cells JOIN places USING (g) GROUP BY ALL),
        sides AS (
            SELECT b.outcome, b.s, b.g AS "group", a.g AS against, b.k::INTEGER AS place,
                a.n AS na, a.m AS ma, a.v AS va, b.n AS nb, b.m AS mb, b.v AS vb
            FROM sums a JOIN sums b ON a.outcome = b.outcome AND a.s = b.s WHERE a.k = 1 AND b.k > 1)
        SELECT outcome, "group", against, place,
            CASE WHEN s THEN 'Raw Difference (Suspicious)' ELSE 'Raw Difference (Normal)' END
                AS effect_size_type, {sql_round("abs(ma - mb)", "effect_size")} FROM sides
        UNION ALL
        SELECT outcome, "group", against, place,
            CASE WHEN s THEN 'Cohen''s d (Suspicious)' ELSE 'Cohen''s d (Normal)' END,
            {sql_round("CASE WHEN na <= 1 OR nb <= 1 OR (va = 0 AND vb = 0) THEN 0 ELSE (ma - mb) "
                       "/ sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) END", "effect_size")}
        FROM sides""",
    "with_without_chart": f"""
        WITH {SQL_EFFECTS}
        SELECT outcome, scope, 'mean' AS measure, g AS label, {sql_round("m", "value")},
            {sql_round("coalesce(sd, 0)", "spread")}
        FROM stats WHERE scope <> 'suspicious_only'
        UNION ALL
        SELECT outcome, scope, 'effect_size', pair, {sql_round("d", "value")}, NULL
        FROM pairs WHERE scope <> 'suspicious_only'""",
    "with_without_chart_p_values": f"""
        WITH {SQL_TESTED}
        SELECT outcome, scope, 'p_value_x100' AS measure, pair AS label, {sql_round("p * 100", "value", 4)},
            NULL::DOUBLE AS spread
        FROM tested WHERE scope <> 'suspicious_only'""",
    "zscore_outliers": f"""
        WITH base AS ({SQL_EVENTS}),
        cells AS (SELECT row_id, 'value' AS "column", value FROM base
                  UNION ALL SELECT row_id, 'user_id', user_id::DOUBLE FROM base),
        scored AS (
            SELECT *, (value - avg(value) OVER (PARTITION BY "column"))
                / stddev_samp(value) OVER (PARTITION BY "column") AS z FROM cells)
        SELECT row_id AS row_index, "column", {sql_round("value", "value")}, {sql_round("z", "z_score")},
            3.0::DOUBLE AS threshold
        FROM scored WHERE abs(z) > 3""",
    "context_rows": f"WITH {_CONTEXT} SELECT * FROM shown",
    "context_totals": f"""
        WITH {_CONTEXT}
        SELECT count(*) AS displayed_rows, (SELECT count(*) FROM base) - count(*) AS skipped_rows FROM shown""",
    "segment_range_rows": """
        SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'F' THEN [o_custkey, 3] WHEN 'O' THEN [o_custkey]
            ELSE range(o_custkey, o_custkey + length(o_orderpriority) + 1) END) AS row_index
        FROM orders""",
    "row_issues": f"WITH {_ISSUES} SELECT * FROM rows_",
    "issue_counts": f"WITH {_ISSUES} SELECT issue_type, count(*) AS rows FROM rows_ GROUP BY issue_type",
    "cell_highlights": f"""
        WITH {_ISSUES}
        SELECT row_index, "column", arg_max(cell_type, rank) AS cell_type, arg_max(cell, rank) AS explanation
        FROM issues GROUP BY row_index, "column" """,
    "findings_summary": f"""
        WITH {_ISSUES},
        typed AS (
            SELECT issue_type, count(*) AS n FROM issues WHERE issue_type <> 'segment_anomaly' GROUP BY 1)
        SELECT CASE issue_type WHEN 'duplicate_id' THEN 'duplicate_ids' ELSE issue_type END AS type,
            CASE issue_type WHEN 'duplicate_id' THEN 'Duplicate Ids' WHEN 'sorting_anomaly'
                THEN 'Sorting Anomaly' ELSE 'Statistical Anomaly' END AS title,
            n AS finding_count, false AS significance_changed,
            (SELECT sum(n)::BIGINT FROM typed) AS total_issues, (SELECT count(*) FROM typed) AS distinct_types
        FROM typed""",
}
