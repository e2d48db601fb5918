"""Terminal digits, distribution shape and crowding near the mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import joined, rounded, sql_gamma_tail, sql_round, sql_shapiro, table
from tamperlens.operators.digits import digit_histogram, keep_suspicious, terminal_digits
from tamperlens.operators.distribution import (
    density_grid,
    density_peaks,
    distribution_stats,
    gap_analysis,
    multimodality,
    shapiro_normality,
)
from tamperlens.operators.inliers import inlier_bands

LINE_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def _flat_digits(result):
    """Without the p-value, which SQL cannot compute; its tier stays."""
    counts = F.array_join(
        F.array(*[F.col("terminal_digit_counts")[str(d)].cast("string") for d in range(10)]), ","
    )
    return rounded(
        result.withColumn("terminal_digit_counts", counts)
        .withColumn("patterns_detected", joined("patterns_detected"))
        .drop("p_value")
    )


def line_digits(spark, sf_dir):
    return _flat_digits(terminal_digits(table(spark, sf_dir, "lineitem")))


def event_digits(spark, sf_dir):
    return _flat_digits(terminal_digits(table(spark, sf_dir, "events"), ["value"]))


def part_digits(spark, sf_dir):
    return _flat_digits(terminal_digits(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"]))


def line_histogram(spark, sf_dir):
    return digit_histogram(table(spark, sf_dir, "lineitem"))


def suspicious_digits(spark, sf_dir):
    return _flat_digits(keep_suspicious(terminal_digits(table(spark, sf_dir, "lineitem"))))


def digit_p_values(spark, sf_dir):
    found = terminal_digits(table(spark, sf_dir, "lineitem"))
    return rounded(found.select("column", "chi_square", "p_value"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "value", "user_id")


def event_stats(spark, sf_dir):
    return rounded(distribution_stats(_events(spark, sf_dir), ["value"], "event_type"))


def event_stats_with_overall(spark, sf_dir):
    found = distribution_stats(
        _events(spark, sf_dir), ["value", "user_id"], "event_type", include_overall=True
    )
    return rounded(found)


def _large(found):
    """The rows and columns of the SQL, which lists no group that is too small for the check."""
    return rounded(found.where("error IS NULL").drop("error"))


def event_gaps(spark, sf_dir):
    return _large(gap_analysis(_events(spark, sf_dir), ["value"], "event_type"))


def event_density(spark, sf_dir):
    return _large(density_grid(_events(spark, sf_dir), ["value"], "event_type"))


def event_peaks(spark, sf_dir):
    return _large(density_peaks(_events(spark, sf_dir), ["value"], "event_type"))


def event_normality(spark, sf_dir):
    return _large(shapiro_normality(_events(spark, sf_dir), ["value", "user_id"], "event_type"))


def _flat_shapes(found):
    peaks = F.array_join(F.transform("peak_values", lambda x: F.format_string("%.4f", x)), ",")
    return rounded(found.withColumn("peak_values", peaks), 4)


def event_shapes(spark, sf_dir):
    """Groups of about 2000 rows at the small scale, so the score has a Shapiro part."""
    return _flat_shapes(multimodality(_events(spark, sf_dir), ["value", "user_id"], "event_type"))


def line_shapes(spark, sf_dir):
    """Groups above 5000 rows, so the score has no Shapiro part."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return _flat_shapes(multimodality(lines, ["l_quantity", "l_extendedprice"], "l_returnflag"))


def event_bands(spark, sf_dir):
    return rounded(inlier_bands(_events(spark, sf_dir), ["value"], "event_type"))


def event_bands_with_overall(spark, sf_dir):
    found = inlier_bands(
        _events(spark, sf_dir), ["value", "user_id"], "event_type", include_overall=True
    )
    return rounded(found)


QUERIES = {
    "terminal_digits": line_digits,
    "terminal_digits_events": event_digits,
    "terminal_digits_part": part_digits,
    "digit_histogram": line_histogram,
    "keep_suspicious": suspicious_digits,
    "terminal_digits_p_value": digit_p_values,
    "distribution_stats": event_stats,
    "distribution_stats_overall": event_stats_with_overall,
    "gap_analysis": event_gaps,
    "density_grid": event_density,
    "density_peaks": event_peaks,
    "shapiro_normality": event_normality,
    "multimodality": event_shapes,
    "multimodality_lineitem": line_shapes,
    "inlier_bands": event_bands,
    "inlier_bands_overall": event_bands_with_overall,
}


def _sql_digits(source: str, columns: dict[str, str]) -> str:
    """CTEs ending in ``result``; columns map a name to its digit expression."""
    cells = " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", ({digit})::INTEGER AS digit FROM {source} WHERE {name} IS NOT NULL"
        for name, digit in columns.items()
    )
    return f"""
        cells AS ({cells}),
        hist AS (
            SELECT n."column", d.digit::INTEGER AS digit, count(c.digit) AS count
            FROM (SELECT DISTINCT "column" FROM cells) n CROSS JOIN range(10) d(digit)
            LEFT JOIN cells c ON c."column" = n."column" AND c.digit = d.digit
            GROUP BY ALL),
        totals AS (SELECT "column", sum(count) AS n FROM hist GROUP BY "column" HAVING sum(count) >= 20),
        tests AS (
            SELECT "column", max(n) AS n, sum((count - n / 10) * (count - n / 10) / (n / 10)) AS chi2,
                -sum(CASE WHEN count > 0 THEN (count / n) * log2(count / n) ELSE 0 END) / log2(10) AS entropy,
                string_agg(count::VARCHAR, ',' ORDER BY digit) AS counts,
                arg_max(digit, count * 10 - digit) AS most,
                arg_min(digit, count * 10 + digit) FILTER (WHERE count > 0) AS least,
                sum(count) FILTER (WHERE digit % 2 = 0) / max(n) AS even,
                sum(count) FILTER (WHERE digit = 5) / max(n) AS five,
                sum(count) FILTER (WHERE digit = 0) / max(n) AS zero
            FROM hist JOIN totals USING ("column") GROUP BY "column"),
        tiered AS (
            SELECT *, CASE WHEN chi2 > 27.87716487125657 THEN 'high' WHEN chi2 > 21.665994333461924
                THEN 'medium' WHEN chi2 > 16.918977604620448 THEN 'low' ELSE 'none' END AS suspicion
            FROM tests),
        result AS (
            SELECT "column", counts AS terminal_digit_counts, {sql_round("chi2", "chi_square")},
                {sql_round("entropy", "entropy")}, suspicion,
                (CASE suspicion WHEN 'high' THEN 9 WHEN 'medium' THEN 7 WHEN 'low' THEN 5 ELSE 3
                    END)::INTEGER AS suspicion_score,
                most AS most_common_digit, least AS least_common_digit,
                concat_ws(',', CASE WHEN even > 0.65 THEN 'even_digits_overrepresented' END,
                    CASE WHEN five > 0.2 THEN 'digit_5_overrepresented' END,
                    CASE WHEN zero > 0.2 THEN 'digit_0_overrepresented' END) AS patterns_detected,
                n::BIGINT AS sample_size, NULL::VARCHAR AS error
            FROM tiered)"""


def _ones(column: str) -> str:
    return f"floor(abs({column}))::BIGINT % 10"


_LINE_DIGITS = _sql_digits("lineitem", {c: _ones(c) for c in LINE_NUMBERS})


def _sql_cells(source: str, columns: list[str], by: str, overall: bool) -> str:
    parts = []
    for c in columns:
        parts.append(f"SELECT '{c}' AS \"column\", {by} AS \"group\", {c}::DOUBLE AS value FROM {source}")
        if overall:
            parts.append(f"SELECT '{c}', NULL, {c}::DOUBLE FROM {source}")
    return " UNION ALL ".join(parts)


def _sql_stats(source: str, columns: list[str], by: str, overall: bool) -> str:
    """CTEs ending in ``stats`` per column and group; ``gk`` is the joinable group."""
    return f"""
        raw AS ({_sql_cells(source, columns, by, overall)}),
        cells AS (SELECT *, coalesce("group", '<all>') AS gk FROM raw),
        stats AS (
            SELECT "column", "group", gk, count(*) AS n, avg(value) AS mean, median(value) AS median,
                stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx,
                var_pop(value) AS vp, kurtosis_pop(value) AS kurtosis
            FROM cells GROUP BY ALL HAVING count(*) >= 20),
        third AS (
            SELECT c."column", c.gk, avg(pow(value - mean, 3)) / pow(any_value(vp), 1.5) AS skewness
            FROM cells c JOIN stats s ON c."column" = s."column" AND c.gk = s.gk GROUP BY ALL),
        gaps AS (
            SELECT "column", gk, max(step) AS gap FROM (
                SELECT "column", gk, value - lag(value) OVER (PARTITION BY "column", gk ORDER BY value) AS step
                FROM cells) GROUP BY ALL),
        counts AS (SELECT "column", gk, value, count(*) AS c FROM cells GROUP BY ALL),
        grid AS (
            SELECT "column", "group", gk, n, sd * pow(n, -0.2) AS h, i,
                CASE WHEN i = 99 THEN mx ELSE mn + i * ((mx - mn) / 99) END AS x
            FROM stats CROSS JOIN range(100) t(i) WHERE sd > 0),
        density AS (
            SELECT g."column", g."group", g.gk, i, x,
                sum(c * exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))
                    AS density
            FROM grid g JOIN counts c ON g."column" = c."column" AND g.gk = c.gk GROUP BY ALL),
        near AS (
            SELECT *, lag(density) OVER w AS l, lead(density) OVER w AS r FROM density
            WINDOW w AS (PARTITION BY "column", gk ORDER BY i)),
        peaks AS (
            SELECT *, row_number() OVER (PARTITION BY "column", gk ORDER BY density DESC, i) AS k,
                count(*) OVER (PARTITION BY "column", gk) AS peak_count
            FROM near WHERE density > l AND density > r)"""


_EVENT_STATS = _sql_stats("events", ["value"], "event_type", False)
_SHOWN_STATS = f"""
        SELECT s."column", s."group", {sql_round("mean", "mean")}, {sql_round("median", "median")},
            {sql_round("sd", "std_dev")}, {sql_round("mn", "min")}, {sql_round("mx", "max")},
            {sql_round("skewness", "skewness")}, {sql_round("kurtosis", "kurtosis")}, n AS sample_size,
            NULL::VARCHAR AS error
        FROM stats s JOIN third t ON s."column" = t."column" AND s.gk = t.gk"""


def _sql_bands(columns: list[str], overall: bool) -> str:
    shares = {"very_close": 0.383, "close": 0.348, "moderate": 0.236, "far": 0.033}
    tests = {
        "very_close": "z < 0.5",
        "close": "z >= 0.5 AND z < 1",
        "moderate": "z >= 1 AND z < 2",
        "far": "z >= 2",
    }
    counts = ", ".join(f"count(*) FILTER (WHERE {t}) AS {b}" for b, t in tests.items())
    ratios = ", ".join(f"{b} / n / {share}::DOUBLE AS {b}_r" for b, share in shares.items())
    shown = ", ".join(
        [f"{b} AS {b}_count" for b in shares]
        + [sql_round(f"{b} / n", f"{b}_pct") for b in shares]
        + [sql_round(f"{b}_r", f"{b}_ratio") for b in shares]
    )
    return f"""
        WITH raw AS ({_sql_cells("events", columns, "event_type", overall)}),
        cells AS (SELECT *, coalesce("group", '<all>') AS gk FROM raw),
        stats AS (
            SELECT "column", "group", gk, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd
            FROM cells GROUP BY ALL HAVING count(*) >= 20),
        scored AS (
            SELECT s."column", s."group", s.n, s.mean, s.sd, abs((value - mean) / sd) AS z
            FROM cells c JOIN stats s ON c."column" = s."column" AND c.gk = s.gk),
        banded AS (SELECT "column", "group", n, mean, sd, {counts} FROM scored GROUP BY ALL),
        ratios AS (SELECT *, {ratios} FROM banded),
        points AS (
            SELECT *, CASE WHEN very_close_r > 1.5 AND very_close >= 10 THEN 3
                           WHEN very_close_r > 1.2 AND very_close >= 10 THEN 1 ELSE 0 END
                + CASE WHEN far_r < 0.5 AND n >= 50 THEN 2 ELSE 0 END
                + CASE WHEN close_r > 1.3 AND moderate_r < 0.7 THEN 2 ELSE 0 END AS pts
            FROM ratios)
        SELECT "column", "group", {sql_round("mean", "mean")}, {sql_round("sd", "std_dev")}, {shown},
            CASE WHEN pts >= 5 THEN 'high' WHEN pts >= 3 THEN 'medium' WHEN pts >= 1 THEN 'low'
                ELSE 'none' END AS suspicion,
            (CASE WHEN pts >= 5 THEN 9 WHEN pts >= 3 THEN 7 WHEN pts >= 1 THEN 5 ELSE 3 END)::INTEGER
                AS suspicion_score,
            n AS sample_size, NULL::VARCHAR AS error
        FROM points"""


def _sql_shapes(source: str, columns: list[str], by: str) -> str:
    return f"""
        WITH {_sql_stats(source, columns, by, False)}, {sql_shapiro()},
        tops AS (
            SELECT "column", gk, max(peak_count) AS peak_count,
                string_agg(printf('%.4f', x), ',' ORDER BY k) FILTER (WHERE k <= 3) AS peak_values,
                max(density) FILTER (WHERE k = 2) / max(density) FILTER (WHERE k = 1) AS ratio
            FROM peaks GROUP BY ALL),
        scored AS (
            SELECT s.*, skewness, gap, p.p AS shapiro_p, coalesce(peak_count, 0) AS peak_count,
                coalesce(peak_values, '') AS peak_values,
                gap > 5 * ((mx - mn) / (n - 1)) AS wide,
                CASE WHEN coalesce(ratio, 0) > 0.7 THEN 3 ELSE 0 END
                + CASE WHEN p.p < 0.001 THEN 2 ELSE 0 END
                + CASE WHEN abs(kurtosis) > 2 THEN 2 ELSE 0 END
                + CASE WHEN gap > 5 * ((mx - mn) / (n - 1)) THEN 2 ELSE 0 END AS pts
            FROM stats s JOIN third t ON s."column" = t."column" AND s.gk = t.gk
            JOIN gaps g ON s."column" = g."column" AND s.gk = g.gk
            LEFT JOIN tops o ON s."column" = o."column" AND s.gk = o.gk
            LEFT JOIN (SELECT "column", gk, p FROM shapiro) p ON s."column" = p."column" AND s.gk = p.gk)
        SELECT "column", "group", {sql_round("mean", "mean", 4)}, {sql_round("median", "median", 4)},
            {sql_round("sd", "std_dev", 4)}, {sql_round("mn", "min", 4)}, {sql_round("mx", "max", 4)},
            {sql_round("skewness", "skewness", 4)}, {sql_round("kurtosis", "kurtosis", 4)},
            {sql_round("shapiro_p", "shapiro_p", 4)}, kurtosis < -0.5 AS potential_multimodal,
            peak_count::BIGINT AS peak_count, peak_values, wide AS suspicious_gaps,
            {sql_round("gap", "max_gap_size", 4)},
            CASE WHEN pts >= 5 THEN 'high' WHEN pts >= 3 THEN 'medium' WHEN pts >= 1 THEN 'low'
                ELSE 'none' END AS suspicion,
            pts::INTEGER AS suspicion_score, n AS sample_size, NULL::VARCHAR AS error
        FROM scored"""


SQL = {
    "terminal_digits": f"WITH {_LINE_DIGITS} SELECT * FROM result",
    "terminal_digits_events": f"WITH {_sql_digits('events', {'value': _ones('value')})} SELECT * FROM result",
    "terminal_digits_part": "WITH "
    + _sql_digits("part", {c: _ones(c) for c in ("p_retailprice", "p_size")})
    + " SELECT * FROM result",
    "digit_histogram": f"WITH {_LINE_DIGITS} SELECT * FROM hist",
    "keep_suspicious": f"""
        WITH {_LINE_DIGITS} SELECT * FROM result WHERE suspicion IN ('medium', 'high')""",
    "distribution_stats": f"WITH {_EVENT_STATS} {_SHOWN_STATS}",
    "distribution_stats_overall": f"""
        WITH {_sql_stats("events", ["value", "user_id"], "event_type", True)} {_SHOWN_STATS}""",
    "gap_analysis": f"""
        WITH {_EVENT_STATS}
        SELECT s."column", s."group", {sql_round("gap", "max_gap_size")},
            {sql_round("(mx - mn) / (n - 1)", "mean_gap")},
            gap > 5 * ((mx - mn) / (n - 1)) AS suspicious_gaps
        FROM stats s JOIN gaps g ON s."column" = g."column" AND s.gk = g.gk""",
    "density_grid": f"""
        WITH {_EVENT_STATS}
        SELECT "column", "group", i::INTEGER AS i, {sql_round("x", "x")}, {sql_round("density", "density")}
        FROM density""",
    "density_peaks": f"""
        WITH {_EVENT_STATS}
        SELECT "column", "group", peak_count, k::INTEGER AS peak_rank, {sql_round("x", "x")},
            {sql_round("density", "density")}
        FROM peaks WHERE k <= 3""",
    "shapiro_normality": f"""
        WITH {_sql_stats("events", ["value", "user_id"], "event_type", False)}, {sql_shapiro()}
        SELECT s."column", s."group", n AS sample_size, {sql_round("w", "shapiro_w")},
            {sql_round("p", "shapiro_p")}, n <= 5000 AS calibrated
        FROM stats s LEFT JOIN (SELECT "column", gk, w, p FROM shapiro) t
            ON s."column" = t."column" AND s.gk = t.gk""",
    "multimodality": _sql_shapes("events", ["value", "user_id"], "event_type"),
    "multimodality_lineitem": _sql_shapes("lineitem", ["l_quantity", "l_extendedprice"], "l_returnflag"),
    "terminal_digits_p_value": f"""
        WITH {_LINE_DIGITS}
        SELECT "column", {sql_round("chi2", "chi_square")},
            {sql_round(sql_gamma_tail("4.5", "chi2 / 2"), "p_value")}
        FROM tests""",
    "inlier_bands": _sql_bands(["value"], False),
    "inlier_bands_overall": _sql_bands(["value", "user_id"], True),
}
