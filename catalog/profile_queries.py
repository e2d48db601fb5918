"""Column and frame profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import joined, rounded, sql_round, table
from tamperlens.operators.profile import (
    column_profile,
    frame_profile,
    listed_values,
    review_candidates,
    suspicion_summary,
    suspicious_columns,
)


def event_profile(spark, sf_dir):
    return rounded(column_profile(table(spark, sf_dir, "events")))


def line_candidates(spark, sf_dir):
    found = review_candidates(column_profile(table(spark, sf_dir, "lineitem")))
    return found.select("column", "dtype", "unique_count")


def order_values(spark, sf_dir):
    source = table(spark, sf_dir, "orders")
    return listed_values(source, ["o_orderstatus", "o_orderpriority"]).withColumn("values", joined("values"))


def line_value_sample(spark, sf_dir):
    found = listed_values(table(spark, sf_dir, "lineitem"))
    return found.select("column", F.size("values").cast("bigint").alias("listed"), "is_sampled")


def _ratings(spark, sf_dir):
    """Stand-in ratings: the share of distinct values on a scale of ten."""
    profile = column_profile(table(spark, sf_dir, "orders"))
    rating = F.floor(F.col("uniqueness_ratio") * 10).cast("int")
    return profile.select("column", F.nullif(rating, F.lit(0)).alias("suspicion_rating"), "unique_count")


def rated_columns(spark, sf_dir):
    return suspicious_columns(_ratings(spark, sf_dir))


def rating_summary(spark, sf_dir):
    return rounded(suspicion_summary(_ratings(spark, sf_dir)))


def line_frame(spark, sf_dir):
    return frame_profile(table(spark, sf_dir, "lineitem"))


QUERIES = {
    "column_profile": event_profile,
    "review_candidates": line_candidates,
    "listed_values": order_values,
    "listed_values_count": line_value_sample,
    "suspicious_columns": rated_columns,
    "suspicion_summary": rating_summary,
    "frame_profile": line_frame,
}

EVENT_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}
LINE_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NUMBERS = ("bigint", "int", "double")


def _sql_profile(name: str, kind: str) -> str:
    numeric = kind in NUMBERS
    stats = [("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"), ("std", "stddev_samp")]
    shown = ", ".join(
        sql_round(f"{fn}({name})", out) if numeric else f"NULL::DOUBLE AS {out}" for out, fn in stats
    )
    unique = f"(count(DISTINCT {name}) + max(CASE WHEN {name} IS NULL THEN 1 ELSE 0 END))"
    return f"""SELECT '{name}' AS "column", '{kind}' AS dtype, {str(numeric).lower()} AS is_numeric,
            {unique}::BIGINT AS unique_count, count(*) AS total_count, count({name}) AS non_null_count,
            {sql_round(f"{unique} / count({name})", "uniqueness_ratio")}, {shown} FROM events"""


def _sql_unique(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, count({c}) AS n FROM {source}" for c in columns
    )


def _sql_types(types: dict[str, str]) -> str:
    return ", ".join(f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(types.items()))


_RATINGS = f"""
        uniques AS ({_sql_unique("orders", ORDER_COLUMNS)}),
        ratings AS (SELECT "column", nullif(floor(u / n * 10), 0)::INTEGER AS rating, u FROM uniques)"""

SQL = {
    "column_profile": " UNION ALL ".join(_sql_profile(c, k) for c, k in EVENT_TYPES.items()),
    "review_candidates": f"""
        WITH uniques AS ({_sql_unique("lineitem", LINE_TYPES)}),
        types(i, "column", dtype) AS (VALUES {_sql_types(LINE_TYPES)})
        SELECT "column", dtype, u AS unique_count FROM uniques JOIN types USING ("column")
        WHERE u BETWEEN 5 AND 1000""",
    "listed_values": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, ',' ORDER BY v) AS "values", false AS is_sampled
            FROM (SELECT DISTINCT {c} AS v FROM orders)"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
    "listed_values_count": f"""
        SELECT "column", least(u, 20)::BIGINT AS listed, u > 20 AS is_sampled
        FROM ({_sql_unique("lineitem", LINE_TYPES)})""",
    "suspicious_columns": f"""
        WITH {_RATINGS} SELECT "column", rating, u AS unique_count FROM ratings WHERE rating >= 7""",
    "suspicion_summary": f"""
        WITH {_RATINGS}
        SELECT count(*) AS total_columns_analyzed, count(*) FILTER (WHERE rating >= 7) AS suspicious_columns,
            {sql_round("avg(coalesce(rating, 0))", "average_suspicion")} FROM ratings""",
    "frame_profile": f"""
        WITH types(position, "column", dtype) AS (VALUES {_sql_types(LINE_TYPES)}),
        nulls AS ({" UNION ALL ".join(
            f"SELECT '{c}' AS c, count(*) - count({c}) AS null_count, count(*) AS row_count FROM lineitem"
            for c in LINE_TYPES)})
        SELECT position::INTEGER AS position, "column", dtype, null_count, row_count,
            {len(LINE_TYPES)}::INTEGER AS column_count
        FROM types JOIN nulls ON c = "column" """,
}
