"""Row identity, row lists, missing values, samples and roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    LINEITEM_ORDER,
    SQL_EVENTS,
    SQL_LINEITEM,
    events,
    numbered,
    round_rows,
    rounded,
    sql_round,
    table,
)
from tamperlens.functions.columns import normalize_missing
from tamperlens.operators.profile import frame_profile
from tamperlens.operators.rows import (
    column_roles,
    head_sample,
    parse_row_spec,
    preview_columns,
    random_sample,
    split_suspicious,
)


def row_ids(spark, sf_dir):
    rows = numbered(spark, sf_dir, "lineitem", LINEITEM_ORDER, *LINEITEM_ORDER)
    return rows.select("row_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def row_spec(spark, sf_dir):
    """Row lists written by hand, here one per order, good and malformed parts mixed."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(
            F.col("o_orderkey").cast("string"),
            F.lit(", "),
            F.col("o_custkey").cast("string"),
            F.lit("-"),
            (F.col("o_custkey") + F.length("o_orderpriority")).cast("string"),
            F.lit(", x, 1-2-3, -5,"),
            (F.col("o_custkey") + 2).cast("string"),
            F.lit("-"),
            F.col("o_custkey").cast("string"),
            F.lit(" , 7 "),
        ).alias("spec"),
    )
    return parse_row_spec(orders, "spec").select("o_orderkey", "row_index")


def missing_values(spark, sf_dir):
    """Values above 100 stand for NaN cells."""
    shown = table(spark, sf_dir, "events").select(
        "event_type",
        F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    return rounded(
        normalize_missing(shown)
        .groupBy("event_type")
        .agg(F.count("value").alias("present"), F.avg("value").alias("mean"))
    )


def suspicious_split(spark, sf_dir):
    rows = events(spark, sf_dir)
    parts = split_suspicious(rows, round_rows(rows))
    result = None
    for scope, part in parts.items():
        counted = part.groupBy("event_type").agg(
            F.count("*").alias("n"), F.sum("value").alias("total")
        )
        counted = counted.withColumn("scope", F.lit(scope))
        result = counted if result is None else result.unionByName(counted)
    return rounded(result, 4)


def roles(spark, sf_dir):
    """Role flags next to the null counts of each column."""
    source = table(spark, sf_dir, "conversations")
    counts = frame_profile(source).select("column", "null_count", "row_count")
    return column_roles(source).join(F.broadcast(counts), "column").select(
        "position", "column", "dtype", "is_id", "is_group", "is_outcome", "null_count", "row_count"
    )


def first_rows(spark, sf_dir):
    return head_sample(events(spark, sf_dir), 10).select("row_id", "event_id", "event_type", "value")


def sampled_rows(spark, sf_dir):
    source = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return random_sample(source, 100, seed=7, key=["event_id"])


def preview_table(spark, sf_dir):
    source = table(spark, sf_dir, "conversations")
    return source.select(*preview_columns(source, "duplicate_id"))


QUERIES = {
    "row_ids": row_ids,
    "parse_row_spec": row_spec,
    "normalize_missing": missing_values,
    "split_suspicious": suspicious_split,
    "column_roles": roles,
    "head_sample": first_rows,
    "random_sample": sampled_rows,
    "preview_columns": preview_table,
}

SQL = {
    "row_ids": f"SELECT row_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ({SQL_LINEITEM})",
    "parse_row_spec": r"""
        WITH specs AS (
            SELECT o_orderkey, o_orderkey || ', ' || o_custkey || '-'
                || (o_custkey + length(o_orderpriority)) || ', x, 1-2-3, -5,'
                || (o_custkey + 2) || '-' || o_custkey || ' , 7 ' AS spec
            FROM orders),
        parts AS (SELECT o_orderkey, trim(unnest(string_split(spec, ','))) AS part FROM specs),
        bounds AS (
            SELECT o_orderkey,
                CASE WHEN regexp_full_match(part, '\d+') THEN part::BIGINT
                     WHEN regexp_full_match(part, '\d+-\d+') THEN split_part(part, '-', 1)::BIGINT END AS lo,
                CASE WHEN regexp_full_match(part, '\d+') THEN part::BIGINT
                     WHEN regexp_full_match(part, '\d+-\d+') THEN split_part(part, '-', 2)::BIGINT END AS hi
            FROM parts)
        SELECT o_orderkey, unnest(range(lo, hi + 1)) AS row_index FROM bounds WHERE lo <= hi""",
    "normalize_missing": f"""
        SELECT event_type, count(*) FILTER (WHERE NOT value > 100) AS present,
            {sql_round("avg(value) FILTER (WHERE NOT value > 100)", "mean")}
        FROM events GROUP BY event_type""",
    "split_suspicious": f"""
        WITH scoped AS (
            SELECT 'full_dataset' AS scope, event_type, value FROM events
            UNION ALL SELECT 'suspicious_only', event_type, value FROM events WHERE value = floor(value)
            UNION ALL SELECT 'without_suspicious', event_type, value FROM events WHERE value <> floor(value))
        SELECT event_type, count(*) AS n, {sql_round("sum(value)", "total", 4)}, scope
        FROM scoped GROUP BY scope, event_type""",
    "column_roles": """
        WITH names(position, "column", dtype, is_id, is_group, is_outcome) AS (VALUES
            (0, 'conv_id', 'bigint', true, false, false), (1, 'turn', 'bigint', false, false, false),
            (2, 'role', 'string', false, false, false), (3, 'text', 'string', false, false, false)),
        counts AS (SELECT count(*) AS n, count(conv_id) AS c0, count(turn) AS c1, count(role) AS c2,
                          count(text) AS c3 FROM conversations)
        SELECT position::INTEGER AS position, "column", dtype, is_id, is_group, is_outcome,
            n - CASE position WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS null_count,
            n AS row_count
        FROM names, counts""",
    "head_sample": f"""
        SELECT row_id, event_id, event_type, value FROM ({SQL_EVENTS}) ORDER BY row_id LIMIT 10""",
    "random_sample": """
        SELECT event_id, event_type, value FROM events
        ORDER BY md5(concat_ws('|', '7', event_id)), event_id LIMIT 100""",
    "preview_columns": "SELECT conv_id, turn, role, text FROM conversations",
}
