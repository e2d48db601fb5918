"""Repeated and misplaced identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    CUSTOMER_ORDER,
    EVENTS_ORDER,
    LINEITEM_ORDER,
    ORDERS_ORDER,
    SQL_CUSTOMER,
    SQL_EVENTS,
    SQL_LINEITEM,
    SQL_ORDERS,
    joined,
    numbered,
    rounded,
    sql_round,
)
from tamperlens.operators.ordering import (
    dependent_var_effects,
    duplicate_id_rows,
    duplicate_ids,
    duplicate_ids_across_groups,
    escalate_severity,
    filter_order_anomalies,
    out_of_sequence_ids,
    previous_ids,
    sorting_anomalies,
)

FLAGS = ["l_returnflag", "l_linestatus"]


def _lineitem(spark, sf_dir, *more):
    return numbered(spark, sf_dir, "lineitem", LINEITEM_ORDER, *LINEITEM_ORDER, *FLAGS, *more)


def _orders(spark, sf_dir):
    return numbered(spark, sf_dir, "orders", ORDERS_ORDER, "o_orderstatus")


def _customers(spark, sf_dir):
    return numbered(spark, sf_dir, "customer", CUSTOMER_ORDER, "c_name", "c_mktsegment", "c_nationkey")


def _flat(findings):
    """Sequence findings with the surrounding ids as text, without the group map."""
    around = F.array_join(
        F.transform(
            "surrounding_ids",
            lambda s: F.concat(s["relative_position"].cast("string"), F.lit(":"), s["id_value"]),
        ),
        ",",
    )
    return findings.withColumn("surrounding_ids", around).drop("condition_values")


def repeated_ids(spark, sf_dir):
    found = duplicate_ids(_lineitem(spark, sf_dir), "l_orderkey")
    return found.withColumn("rows", joined("rows"))


def hot_ids(spark, sf_dir):
    """Three ids that own all rows: their lists come in complete parts."""
    found = duplicate_ids(_lineitem(spark, sf_dir), "l_returnflag")
    return found.withColumn("rows", joined("rows"))


def repeated_id_rows(spark, sf_dir):
    return duplicate_id_rows(_lineitem(spark, sf_dir), "l_orderkey")


def repeated_across_groups(spark, sf_dir):
    found = duplicate_ids_across_groups(_lineitem(spark, sf_dir), "l_orderkey", FLAGS)
    return found.drop("condition_values")


def previous_order_ids(spark, sf_dir):
    return previous_ids(_orders(spark, sf_dir), "o_orderkey")


def misplaced_line_ids(spark, sf_dir):
    return _flat(out_of_sequence_ids(_lineitem(spark, sf_dir), "l_orderkey", FLAGS))


def misplaced_event_ids(spark, sf_dir):
    rows = numbered(spark, sf_dir, "events", EVENTS_ORDER, "event_type")
    return _flat(out_of_sequence_ids(rows, "event_id", "event_type"))


def misplaced_order_ids(spark, sf_dir):
    return _flat(out_of_sequence_ids(_orders(spark, sf_dir), "o_orderkey", "o_orderstatus"))


def misplaced_customer_names(spark, sf_dir):
    return _flat(out_of_sequence_ids(_customers(spark, sf_dir), "c_name", "c_mktsegment"))


def ordering_clusters(spark, sf_dir):
    found = out_of_sequence_ids(_orders(spark, sf_dir), "o_orderkey", "o_orderstatus")
    return filter_order_anomalies(found).select(
        "row_index", "id_value", "position_difference", "cluster_size", "severity", "description"
    )


def measured_effects(spark, sf_dir):
    """Rows with a value above 100 against all others."""
    rows = numbered(spark, sf_dir, "events", EVENTS_ORDER, "user_id", "value")
    listed = rows.filter("value > 100").select(F.col("row_id").alias("row_index"))
    return rounded(dependent_var_effects(rows, listed, ["value", "user_id"]))


def escalated_names(spark, sf_dir):
    """Misplaced names; the effect rows are the customers above a balance of 5000."""
    rows = _customers(spark, sf_dir)
    found = out_of_sequence_ids(rows, "c_name", "c_mktsegment")
    listed = rows.filter("c_acctbal > 5000").select(F.col("row_id").alias("row_index"))
    effects = dependent_var_effects(rows, listed, ["c_acctbal", "c_nationkey"])
    names = F.array_join(F.transform("dependent_var_effects", lambda e: e["column"]), ",")
    return escalate_severity(found, effects, ["c_acctbal", "c_nationkey"]).select(
        "row_index", "id_value", "severity", names.alias("effect_columns")
    )


def ranked_anomalies(spark, sf_dir):
    found = sorting_anomalies(_lineitem(spark, sf_dir, "l_quantity"), "l_orderkey", FLAGS)
    return found.select(
        "type",
        "id_value",
        "row_index",
        "group_label",
        "duplicate_count",
        "different_conditions",
        "position_difference",
        "cluster_size",
        "severity",
        "description",
        "previous_id",
        F.size("dependent_var_effects").cast("bigint").alias("effects"),
    )


QUERIES = {
    "duplicate_ids": repeated_ids,
    "duplicate_ids_hot": hot_ids,
    "duplicate_id_rows": repeated_id_rows,
    "duplicate_ids_across_groups": repeated_across_groups,
    "previous_ids": previous_order_ids,
    "out_of_sequence_ids": misplaced_line_ids,
    "out_of_sequence_clean": misplaced_event_ids,
    "out_of_sequence_dense": misplaced_order_ids,
    "out_of_sequence_string_ids": misplaced_customer_names,
    "filter_order_anomalies": ordering_clusters,
    "dependent_var_effects": measured_effects,
    "escalate_severity": escalated_names,
    "sorting_anomalies": ranked_anomalies,
}


def _sql_sequence(source: str, ident: str, groups: list[str], numeric: bool) -> str:
    """CTEs ending in ``found``: sequence findings of one table."""
    keys = ", ".join(groups)
    label = " || ', ' || ".join(f"'{g}=' || {g}" for g in groups)
    if numeric:
        gate, limit, severity = "true", 4, "least(5 + abs(actual - expected), 9)"
        text = "id || ' stands ' || abs(actual - expected) || ' places off its sorted place'"
        before = "previous_in_file"
    else:
        gate, limit, severity = "disordered", 2, "7"
        text = "id || ' stands off its sorted place'"
        before = "m1"
    return f"""
        numbered AS MATERIALIZED ({source}),
        placed AS MATERIALIZED (
            SELECT *, {ident} AS id,
                row_number() OVER (PARTITION BY {keys} ORDER BY row_id) - 1 AS actual,
                count(*) OVER (PARTITION BY {keys} ORDER BY {ident}
                    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS expected,
                lag({ident}) OVER (ORDER BY row_id) AS previous_in_file,
                lag({ident}, 2) OVER (PARTITION BY {keys} ORDER BY row_id) AS m2,
                lag({ident}, 1) OVER (PARTITION BY {keys} ORDER BY row_id) AS m1,
                lead({ident}, 1) OVER (PARTITION BY {keys} ORDER BY row_id) AS p1,
                lead({ident}, 2) OVER (PARTITION BY {keys} ORDER BY row_id) AS p2
            FROM numbered),
        gated AS (SELECT *, bool_or(coalesce(id < m1, false)) OVER (PARTITION BY {keys}) AS disordered
                  FROM placed),
        found AS MATERIALIZED (
            SELECT 'out_of_sequence_id' AS type, id::VARCHAR AS id_value, row_id AS row_index,
                {label} AS group_label, actual AS actual_position, expected AS expected_position,
                abs(actual - expected) AS position_difference,
                concat_ws(',', '-2:' || m2, '-1:' || m1, '0:' || id, '1:' || p1, '2:' || p2)
                    AS surrounding_ids,
                ({severity})::INTEGER AS severity, {text} AS description,
                {before}::VARCHAR AS previous_id
            FROM gated WHERE {gate} AND abs(actual - expected) >= {limit}),
        sized AS (SELECT *, count(*) OVER (PARTITION BY group_label) AS size FROM found),
        kept AS (
            SELECT * EXCLUDE (size, severity, description),
                CASE WHEN size >= 5 THEN size END AS cluster_size,
                CASE WHEN size >= 5 THEN least(severity + 1, 9) ELSE severity END AS severity,
                CASE WHEN size >= 5 THEN description || ', one of ' || size
                    || ' in ' || group_label ELSE description END AS description
            FROM sized WHERE size >= 5 OR position_difference >= 7)"""


_LINE_SEQUENCE = _sql_sequence(SQL_LINEITEM, "l_orderkey", FLAGS, True)
_ORDER_SEQUENCE = _sql_sequence(SQL_ORDERS, "o_orderkey", ["o_orderstatus"], True)
_EVENT_SEQUENCE = _sql_sequence(SQL_EVENTS, "event_id", ["event_type"], True)
_NAME_SEQUENCE = _sql_sequence(SQL_CUSTOMER, "c_name", ["c_mktsegment"], False)

_LINE_DUPLICATES = f"""
        base AS MATERIALIZED ({SQL_LINEITEM}),
        lagged AS (SELECT *, lag(l_orderkey) OVER (ORDER BY row_id) AS before FROM base),
        per_id AS (
            SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS conditions
            FROM base GROUP BY l_orderkey),
        repeated AS MATERIALIZED (
            SELECT 'duplicate_id' AS type, l_orderkey::VARCHAR AS id_value, row_id AS row_index,
                'l_returnflag=' || l_returnflag || ', l_linestatus=' || l_linestatus AS group_label,
                n AS duplicate_count, conditions AS different_conditions, 9::INTEGER AS severity,
                l_orderkey || ' stands in ' || conditions || ' groups' AS description,
                before::VARCHAR AS previous_id
            FROM lagged JOIN per_id USING (l_orderkey) WHERE n > 1 AND conditions > 1)"""


def _sql_effects(listed: str, source: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value, {listed} AS a FROM {source}" for c in columns
    )
    return f"""
        cells AS ({cells}),
        sides AS (
            SELECT "column", avg(value) FILTER (WHERE a) AS ma, avg(value) FILTER (WHERE NOT a) AS mn,
                stddev_samp(value) FILTER (WHERE a) AS sa, stddev_samp(value) FILTER (WHERE NOT a) AS sn,
                count(value) FILTER (WHERE a) AS na, count(value) FILTER (WHERE NOT a) AS nn
            FROM cells GROUP BY "column"),
        effects AS (
            SELECT *, CASE WHEN sn > 0 THEN (ma - mn) / sn ELSE 0 END AS d FROM sides
            WHERE na >= 2 AND nn >= 2 AND abs(CASE WHEN sn > 0 THEN (ma - mn) / sn ELSE 0 END) >= 0.5)"""


SQL = {
    "duplicate_ids": f"""
        SELECT 'duplicate_id' AS type, l_orderkey::VARCHAR AS id_value, count(*) AS count,
            0::BIGINT AS part, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS rows, 9::INTEGER AS severity,
            l_orderkey || ' stands in ' || count(*) || ' rows' AS description
        FROM ({SQL_LINEITEM}) GROUP BY l_orderkey HAVING count(*) > 1""",
    "duplicate_ids_hot": f"""
        SELECT 'duplicate_id' AS type, l_returnflag AS id_value, any_value(n) AS count, part,
            string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS rows, 9::INTEGER AS severity,
            l_returnflag || ' stands in ' || any_value(n) || ' rows' AS description
        FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS n FROM ({SQL_LINEITEM})),
            LATERAL (SELECT CASE WHEN n <= 1000 THEN 0 ELSE row_id // 1000 END::BIGINT AS part)
        WHERE n > 1 GROUP BY l_returnflag, part""",
    "duplicate_id_rows": f"""
        SELECT id_value, row_index, count FROM (
            SELECT l_orderkey::VARCHAR AS id_value, row_id AS row_index,
                count(*) OVER (PARTITION BY l_orderkey) AS count FROM ({SQL_LINEITEM}))
        WHERE count > 1""",
    "duplicate_ids_across_groups": f"WITH {_LINE_DUPLICATES} SELECT * FROM repeated",
    "previous_ids": f"""
        SELECT row_id AS row_index, o_orderkey::VARCHAR AS id_value,
            lag(o_orderkey) OVER (ORDER BY row_id)::VARCHAR AS previous_id
        FROM ({SQL_ORDERS})""",
    "out_of_sequence_ids": f"WITH {_LINE_SEQUENCE} SELECT * FROM found",
    "out_of_sequence_clean": f"WITH {_EVENT_SEQUENCE} SELECT * FROM found",
    "out_of_sequence_dense": f"WITH {_ORDER_SEQUENCE} SELECT * FROM found",
    "out_of_sequence_string_ids": f"WITH {_NAME_SEQUENCE} SELECT * FROM found",
    "filter_order_anomalies": f"""
        WITH {_ORDER_SEQUENCE}
        SELECT row_index, id_value, position_difference, cluster_size, severity, description FROM kept""",
    "dependent_var_effects": f"""
        WITH {_sql_effects("value > 100", "events", ["value", "user_id"])}
        SELECT "column", {sql_round("d", "effect_size")},
            CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END AS direction,
            {sql_round("ma", "anomalous_mean")}, {sql_round("mn", "non_anomalous_mean")},
            {sql_round("sa", "anomalous_std")}, {sql_round("sn", "non_anomalous_std")}
        FROM effects""",
    "escalate_severity": f"""
        WITH {_NAME_SEQUENCE},
        {_sql_effects("c_acctbal > 5000", "customer", ["c_acctbal", "c_nationkey"])}
        SELECT row_index, id_value,
            least(9, severity + (SELECT count(*) FROM effects WHERE abs(d) >= 0.8))::INTEGER AS severity,
            (SELECT coalesce(string_agg("column", ',' ORDER BY "column"), '') FROM effects) AS effect_columns
        FROM found""",
    "sorting_anomalies": f"""
        WITH {_LINE_SEQUENCE}, {_LINE_DUPLICATES},
        unioned AS MATERIALIZED (
            SELECT type, id_value, row_index, group_label, duplicate_count, different_conditions,
                NULL::BIGINT AS position_difference, NULL::BIGINT AS cluster_size, severity,
                description, previous_id FROM repeated
            UNION ALL
            SELECT type, id_value, row_index, group_label, NULL, NULL, position_difference,
                cluster_size, severity, description, previous_id FROM kept),
        hit AS MATERIALIZED (SELECT DISTINCT row_index FROM unioned),
        marked AS MATERIALIZED (
            SELECT base.*, hit.row_index IS NOT NULL AS flagged FROM base LEFT JOIN hit ON row_id = row_index),
        {_sql_effects("flagged", "marked",
                      ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])}
        SELECT type, id_value, row_index, group_label, duplicate_count, different_conditions,
            position_difference, cluster_size,
            least(9, severity + (SELECT count(*) FROM effects WHERE abs(d) >= 0.8))::INTEGER AS severity,
            description, previous_id, (SELECT count(*) FROM effects) AS effects
        FROM unioned""",
}
