"""Row segments, scorers and response roll-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.common import SQL_EVENTS, events, joined, rounded, sql_round, table
from tamperlens.operators.segments import (
    assign_segments,
    extract_response_json,
    report_findings,
    segment_apply,
    segment_bounds,
    segment_describe,
    segment_report,
    segment_rollup,
    segment_types,
)


def default_segments(spark, sf_dir):
    return segment_bounds(assign_segments(events(spark, sf_dir)))


def whole_table_segments(spark, sf_dir):
    return segment_bounds(assign_segments(events(spark, sf_dir), max_chunks=None))


def described_segments(spark, sf_dir):
    rows = assign_segments(events(spark, sf_dir), max_chunks=None)
    return rounded(segment_describe(rows, ["value", "user_id"]))


def _count_high(pdf: pd.DataFrame) -> pd.DataFrame:
    high = pdf["value"] > pdf["value"].mean()
    if pdf["value"].max() > 480:
        raise ValueError("value out of range")
    return pd.DataFrame({"n": [len(pdf)], "high": [int(high.sum())]})


def scored_segments(spark, sf_dir):
    """A scorer that fails on segments holding a value above 480."""
    rows = assign_segments(events(spark, sf_dir), max_chunks=None)
    return segment_apply(rows, _count_high, "n bigint, high bigint")


def _responses(spark, sf_dir):
    """Free-text answers: JSON inside prose, broken JSON, and none at all."""
    value, user = F.col("value"), F.col("user_id").cast("string")
    body = F.concat(
        F.lit('{"anomalies_detected": '),
        F.when(value > 50, "true").otherwise("false"),
        F.lit(', "confidence": '),
        F.length("props").cast("string"),
        F.lit(', "explanation": "user '),
        user,
        F.lit('", "findings": [{"type": "'),
        F.col("event_type"),
        F.lit('", "description": "d", "severity": 7, "row_indices": ['),
        F.array_join(F.transform(F.sequence(F.lit(1), (F.col("user_id") % 20 + 1).cast("int")), lambda i: i.cast("string")), ","),
        F.lit('], "columns_involved": ["value", "props"]}]}'),
    )
    text = (
        F.when(value < 10, F.concat(F.lit("Nothing found for "), user))
        .when(value < 20, F.concat(F.lit("{broken "), user))
        .otherwise(F.concat(F.lit("Here is the answer:\n"), body, F.lit("\nRegards")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk"), text.alias("response"))


def parsed_responses(spark, sf_dir):
    found = extract_response_json(_responses(spark, sf_dir))
    first = F.col("findings")[0]
    return found.select(
        "chunk",
        "anomalies_detected",
        "confidence",
        "explanation",
        first["type"].alias("type"),
        F.size(F.coalesce(first["row_indices"], F.array().cast("array<bigint>"))).cast("bigint").alias("rows"),
        "error",
        "raw_response",
    )


def whole_responses(spark, sf_dir):
    """Keys that the fixed columns do not know, in the answer and in its finding."""
    more = F.replace("response", F.lit('"severity": 7'), F.lit('"severity": 7, "score": 0.5'))
    extra = F.concat(F.lit('"extra": {"chunk": '), F.col("chunk").cast("string"), F.lit('}, "confidence"'))
    answers = _responses(spark, sf_dir).withColumn("response", F.replace(more, F.lit('"confidence"'), extra))
    return extract_response_json(answers).selectExpr(
        "chunk", "variant_get(parsed, '$.extra.chunk', 'bigint') AS extra_chunk",
        "variant_get(parsed, '$.findings[0].score', 'double') AS score", "parsed IS NOT NULL AS readable",
    )


def rolled_up(spark, sf_dir):
    return segment_rollup(extract_response_json(_responses(spark, sf_dir)))


def found_types(spark, sf_dir):
    return segment_types(extract_response_json(_responses(spark, sf_dir)))


def reported(spark, sf_dir):
    return segment_report(extract_response_json(_responses(spark, sf_dir)))


def reported_findings(spark, sf_dir):
    found = report_findings(extract_response_json(_responses(spark, sf_dir)))
    return found.withColumn("row_indices", joined("row_indices"))


QUERIES = {
    "segments": default_segments,
    "segments_full_coverage": whole_table_segments,
    "segment_describe": described_segments,
    "segment_apply": scored_segments,
    "extract_response_json": parsed_responses,
    "response_objects": whole_responses,
    "segment_rollup": rolled_up,
    "segment_types": found_types,
    "segment_report": reported,
    "report_findings": reported_findings,
}

_SEGMENTS = f"""
        base AS ({SQL_EVENTS}),
        total AS (SELECT count(*) AS n, greatest(50, least(500,
            CASE WHEN count(*) <= 1000 THEN count(*) ELSE count(*) // 10 END)) AS size FROM base),
        segments AS (
            SELECT base.*, row_id // size + 1 AS chunk,
                (row_id // size * size) || '-' || least((row_id // size + 1) * size, n) AS rows
            FROM base, total)"""

_BOUNDS = """SELECT chunk, rows, min(row_id) AS start_row, max(row_id) AS last_row, count(*) AS n
        FROM segments"""

_RESPONSES = """
        answers AS (
            SELECT event_id AS chunk, value >= 20 AS ok, value > 50 AS anomalous, length(props) AS confidence,
                user_id, event_type, value, user_id % 20 + 1 AS listed
            FROM events),
        confident AS (SELECT * FROM answers WHERE ok AND anomalous AND confidence >= 7)"""


def _sql_described(column: str) -> str:
    quartiles = ", ".join(
        sql_round(f"quantile_cont({column}::DOUBLE, {q})", name)
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    )
    return f"""SELECT chunk, '{column}' AS "column", count(*) AS count, {sql_round(f"avg({column})", "mean")},
            {sql_round(f"stddev_samp({column})", "std")}, {sql_round(f"min({column})", "min")}, {quartiles},
            {sql_round(f"max({column})", "max")} FROM segments GROUP BY chunk"""


SQL = {
    "segments": f"WITH {_SEGMENTS} {_BOUNDS} GROUP BY ALL",
    "segments_full_coverage": f"WITH {_SEGMENTS} {_BOUNDS} GROUP BY ALL",
    "segment_describe": f"""
        WITH {_SEGMENTS} {_sql_described("value")} UNION ALL {_sql_described("user_id")}""",
    "segment_apply": f"""
        WITH {_SEGMENTS},
        means AS (SELECT *, avg(value) OVER (PARTITION BY chunk) AS m, max(value) OVER (PARTITION BY chunk) AS mx
                  FROM segments)
        SELECT chunk, rows, CASE WHEN max(mx) <= 480 THEN count(*) END AS n,
            CASE WHEN max(mx) <= 480 THEN count(*) FILTER (WHERE value > m) END AS high,
            CASE WHEN max(mx) > 480 THEN 'value out of range' END AS error
        FROM means GROUP BY chunk, rows""",
    "extract_response_json": f"""
        WITH {_RESPONSES}
        SELECT chunk, ok AND anomalous AS anomalies_detected,
            CASE WHEN ok THEN confidence::DOUBLE END AS confidence,
            CASE WHEN ok THEN 'user ' || user_id END AS explanation,
            CASE WHEN ok THEN event_type END AS type,
            CASE WHEN ok THEN listed ELSE 0 END AS rows,
            CASE WHEN NOT ok THEN 'no readable JSON object in the response' END AS error,
            CASE WHEN value < 10 THEN 'Nothing found for ' || user_id
                WHEN value < 20 THEN '{{broken ' || user_id END AS raw_response
        FROM answers""",
    "response_objects": f"""
        WITH {_RESPONSES}
        SELECT chunk, CASE WHEN ok THEN chunk END AS extra_chunk, CASE WHEN ok THEN 0.5::DOUBLE END AS score, ok AS readable
        FROM answers""",
    "segment_rollup": f"""
        WITH {_RESPONSES}
        SELECT (SELECT count(*) FROM confident) AS anomaly_chunks,
            (SELECT count(*) FROM confident) AS total_anomalies,
            (SELECT count(DISTINCT event_type) FROM confident) AS anomaly_types,
            count(*) AS total_chunks FROM answers""",
    "segment_types": f"""
        WITH {_RESPONSES} SELECT event_type AS type, count(*) AS findings FROM confident GROUP BY event_type""",
    "segment_report": f"""
        WITH {_RESPONSES}
        SELECT count(*) AS segments_analyzed, count(*) FILTER (WHERE NOT ok) AS error_segments,
            count(*) FILTER (WHERE ok AND anomalous) AS segments_with_anomalies,
            count(*) FILTER (WHERE ok AND anomalous AND confidence >= 7) AS high_confidence_segments
        FROM answers""",
    "report_findings": f"""
        WITH {_RESPONSES}
        SELECT chunk, confidence::DOUBLE AS confidence, 1::INTEGER AS finding, event_type AS type,
            '7' AS severity, 'd' AS description, 'value, props' AS columns_involved,
            CASE WHEN listed <= 10 THEN array_to_string(range(1, listed + 1), ', ')
                ELSE '1, 2, 3, 4, 5, ... (' || (listed - 10) || ' more rows) ..., '
                    || array_to_string(range(listed - 4, listed + 1), ', ') END AS rows_affected,
            array_to_string(range(1, listed + 1), ',') AS row_indices
        FROM confident""",
}
