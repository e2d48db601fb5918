"""Group comparisons with and without suspicious rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SQL_EVENTS, events, round_rows, rounded, sql_round, sql_t_two_sided
from tamperlens.operators.effects import (
    compare_with_without,
    descriptive_stats,
    group_order,
    significance_change,
    suspicious_effects,
)

OUTCOMES = ["value", "user_id"]


def _inputs(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows, round_rows(rows), "event_type", OUTCOMES


def event_groups(spark, sf_dir):
    return group_order(events(spark, sf_dir), "event_type").withColumnRenamed("_g", "group")


def welch_comparison(spark, sf_dir):
    found = compare_with_without(*_inputs(spark, sf_dir), all_pairs=True)
    return rounded(found.drop("p_value", "significant"))


def welch_p_values(spark, sf_dir):
    found = compare_with_without(*_inputs(spark, sf_dir), all_pairs=True)
    return rounded(found.select("scope", "outcome", "pair", "t_statistic", "p_value", "significant"))


def group_descriptions(spark, sf_dir):
    return rounded(descriptive_stats(*_inputs(spark, sf_dir)))


def first_comparison(spark, sf_dir):
    """Each event type against the first one to appear."""
    found = compare_with_without(*_inputs(spark, sf_dir))
    return rounded(found.select("scope", "outcome", "pair", "mean_difference", "cohens_d", "n1", "n2"))


def changed_results(spark, sf_dir):
    found = significance_change(*_inputs(spark, sf_dir), all_pairs=True)
    return rounded(found.drop("with_p_value", "without_p_value", "significance_changed"))


def changed_significance(spark, sf_dir):
    found = significance_change(*_inputs(spark, sf_dir), all_pairs=True)
    return rounded(
        found.select("column", "pair", "with_p_value", "without_p_value", "significance_changed")
    )


def unusual_rows(spark, sf_dir):
    """Rows with values above 120 as the listed rows."""
    rows = events(spark, sf_dir)
    listed = rows.filter("value > 120").select(F.col("row_id").alias("row_index"))
    return rounded(suspicious_effects(rows, listed, "event_type", OUTCOMES))


QUERIES = {
    "group_order": event_groups,
    "compare_with_without": welch_comparison,
    "compare_with_first": first_comparison,
    "welch_p_values": welch_p_values,
    "descriptive_stats": group_descriptions,
    "significance_change": changed_results,
    "significance_change_p_values": changed_significance,
    "suspicious_effects": unusual_rows,
}

_BASE = f"""
        base AS ({SQL_EVENTS}),
        cells AS (
            SELECT row_id, event_type AS g, value = floor(value) AS s, 'value' AS outcome, value FROM base
            UNION ALL
            SELECT row_id, event_type, value = floor(value), 'user_id', user_id::DOUBLE FROM base),
        scoped AS (
            SELECT 'full_dataset' AS scope, * FROM cells
            UNION ALL
            SELECT CASE WHEN s THEN 'suspicious_only' ELSE 'without_suspicious' END, * FROM cells),
        stats AS (
            SELECT scope, outcome, g, count(*) AS n, avg(value) AS m, var_samp(value) AS v,
                median(value) AS md, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx
            FROM scoped GROUP BY ALL),
        firsts AS (SELECT event_type AS g, min(row_id) AS first_row FROM base GROUP BY 1),
        pairs AS (
            SELECT a.scope, a.outcome, a.g AS group1, b.g AS group2, a.g || ' vs ' || b.g AS pair,
                (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, b.m - a.m AS diff,
                (b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d,
                a.n AS n1, b.n AS n2,
                pow(a.v / a.n + b.v / b.n, 2)
                    / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS freedom
            FROM stats a JOIN stats b ON a.scope = b.scope AND a.outcome = b.outcome
            JOIN firsts fa ON fa.g = a.g JOIN firsts fb ON fb.g = b.g
            WHERE fa.first_row < fb.first_row AND a.n >= 2 AND b.n >= 2)"""

# two-sided p-values of all pairs
_TESTED = f"""{_BASE},
        tested AS (SELECT *, {sql_t_two_sided("t", "freedom")} AS p FROM pairs)"""

SQL = {
    "welch_p_values": f"""
        WITH {_TESTED}
        SELECT scope, outcome, pair, {sql_round("t", "t_statistic")}, {sql_round("p", "p_value")},
            p < 0.05 AS significant
        FROM tested""",
    "significance_change_p_values": f"""
        WITH {_TESTED}
        SELECT f.outcome AS "column", f.pair, {sql_round("f.p", "with_p_value")},
            {sql_round("w.p", "without_p_value")}, (f.p < 0.05) <> (w.p < 0.05) AS significance_changed
        FROM tested f JOIN tested w ON f.outcome = w.outcome AND f.pair = w.pair
        WHERE f.scope = 'full_dataset' AND w.scope = 'without_suspicious'""",
    "compare_with_first": f"""
        WITH {_BASE}
        SELECT scope, outcome, pair, {sql_round("diff", "mean_difference")}, {sql_round("d", "cohens_d")}, n1, n2
        FROM pairs WHERE group1 = (SELECT arg_min(g, first_row) FROM firsts)""",
    "group_order": f"""
        SELECT event_type AS "group", min(row_id) AS first_row FROM ({SQL_EVENTS}) GROUP BY 1""",
    "compare_with_without": f"""
        WITH {_BASE}
        SELECT scope, outcome, group1, group2, pair, {sql_round("t", "t_statistic")},
            {sql_round("diff", "mean_difference")}, {sql_round("d", "cohens_d")}, n1, n2,
            CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small'
                WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size_interpretation,
            NULL::VARCHAR AS error
        FROM pairs""",
    "descriptive_stats": f"""
        WITH {_BASE}
        SELECT scope, outcome, g AS "group", {sql_round("m", "mean")}, {sql_round("md", "median")},
            {sql_round("coalesce(sd, 0)", "std")}, {sql_round("mn", "min")}, {sql_round("mx", "max")}, n
        FROM stats""",
    "significance_change": f"""
        WITH {_BASE},
        columns_ AS (
            SELECT outcome, avg(value) AS wm, avg(value) FILTER (WHERE NOT s) AS om,
                stddev_samp(value) AS ws, stddev_samp(value) FILTER (WHERE NOT s) AS os
            FROM cells GROUP BY outcome)
        SELECT f.outcome AS "column", f.pair, {sql_round("wm", "with_mean")},
            {sql_round("om", "without_mean")}, {sql_round("ws", "with_std")},
            {sql_round("os", "without_std")},
            {sql_round("(om - wm) / abs(wm) * 100", "mean_change_percent")},
            {sql_round("(os - ws) / abs(ws) * 100", "std_change_percent")},
            {sql_round("f.d", "with_effect_size")}, {sql_round("w.d", "without_effect_size")}
        FROM pairs f JOIN pairs w ON f.outcome = w.outcome AND f.pair = w.pair
        JOIN columns_ c ON c.outcome = f.outcome
        WHERE f.scope = 'full_dataset' AND w.scope = 'without_suspicious'""",
    "suspicious_effects": f"""
        WITH base AS ({SQL_EVENTS}),
        cells AS (
            SELECT row_id, event_type AS g, value > 120 AS s, 'value' AS outcome, value AS x FROM base
            UNION ALL
            SELECT row_id, event_type, value > 120, 'user_id', user_id::DOUBLE FROM base),
        stats AS (
            SELECT outcome, g, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS m2
            FROM cells GROUP BY ALL),
        scored AS (
            SELECT row_id, g, outcome, x, m, x - m AS dist,
                (x - m) / sqrt((m2 - (x - m) * (x - m) * n / (n - 1)) / (n - 2)) AS z
            FROM cells JOIN stats USING (outcome, g) WHERE s AND n >= 3)
        SELECT row_id AS row_index, g AS "group", outcome, {sql_round("x", "value")},
            {sql_round("m", "group_mean")}, {sql_round("dist", "difference")}, {sql_round("z", "z_score")},
            CASE WHEN dist > 0 THEN 'stronger' ELSE 'weaker' END AS effect_direction,
            CASE WHEN abs(z) < 1.5 THEN 'typical' WHEN abs(z) < 2 THEN 'somewhat unusual'
                WHEN abs(z) < 3 THEN 'unusual' WHEN abs(z) < 4 THEN 'very unusual' ELSE 'extreme' END
                AS magnitude,
            'suspicious_effect' AS type
        FROM scored WHERE abs(z) > 1.5""",
}
