"""Tables, row orders and rendering shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperlens.plans.staging import with_row_id
from tamperlens.session import shared_folder

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
EVENTS_ORDER = ["ts", "event_id"]
ORDERS_ORDER = ["o_orderdate", "o_orderkey"]
CUSTOMER_ORDER = ["c_acctbal", "c_custkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str, name: str, order: list[str], *columns: str) -> DataFrame:
    """The table with ``row_id``, only the named columns (all without names)."""
    source = table(spark, sf_dir, name)
    if columns:
        source = source.select(*dict.fromkeys([*columns, *order]))
    return with_row_id(source, order)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, "events", EVENTS_ORDER, "event_id", "user_id", "event_type", "value")


def round_rows(numbered_events: DataFrame) -> DataFrame:
    """Stand-in for suspicious rows: values without decimals."""
    whole = F.col("value") == F.floor("value")
    return numbered_events.filter(whole).select(F.col("row_id").alias("row_index"))


def scratch(spark: SparkSession, name: str) -> str:
    """New folder for files a query derives from the tables."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE columns rounded, without negative zero."""
    changes = {
        f.name: F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(changes) if changes else df


def joined(column: str, sep: str = ",") -> Column:
    """An array as text."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


def sql_numbered(name: str, order: list[str]) -> str:
    keys = ", ".join(order)
    return f"SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS row_id FROM {name}"


SQL_LINEITEM = sql_numbered("lineitem", LINEITEM_ORDER)
SQL_EVENTS = sql_numbered("events", EVENTS_ORDER)
SQL_ORDERS = sql_numbered("orders", ORDERS_ORDER)
SQL_CUSTOMER = sql_numbered("customer", CUSTOMER_ORDER)


def sql_round(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


def sql_gamma_tail(a: str, x: str) -> str:
    """Upper regularised incomplete gamma function, by its power series."""
    term = f"exp(({a}) * ln({x}) - ({x}) - lgamma(({a}) + k + 1) + k * ln({x}))"
    series = f"list_sum(list_transform(range(0, 600), lambda k: {term}))"
    return f"CASE WHEN ({x}) <= 0 THEN 1 WHEN ({x}) > 200 THEN 0 ELSE greatest(1 - {series}, 0) END"


def _sql_log_beta(p: str, q: str) -> str:
    return f"(lgamma({p}) + lgamma({q}) - lgamma(({p}) + ({q})))"


def sql_t_two_sided(t: str, freedom: str) -> str:
    """Two-sided p-value of Student's t, by the series of the incomplete beta function."""
    y, b = f"({t} * {t} / ({freedom} + {t} * {t}))", f"({freedom} / 2)"
    front = f"exp(0.5 * ln({y}) + {b} * ln(1 - {y}) - ln(0.5) - {_sql_log_beta('0.5', b)})"
    term = f"exp({_sql_log_beta('1.5', 'k + 1')} - {_sql_log_beta(f'0.5 + {b}', 'k + 1')} + (k + 1) * ln({y}))"
    series = f"list_sum(list_transform(range(0, 400), lambda k: {term}))"
    return f"CASE WHEN {t} = 0 THEN 1 ELSE greatest(1 - {front} * (1 + {series}), 0) END"


def _sql_poly(coefficients: list[float], x: str) -> str:
    """Polynomial, lowest power first, in Horner form."""
    text = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}::DOUBLE + ({x}) * {text}::DOUBLE)" if "(" not in text else f"({c!r}::DOUBLE + ({x}) * {text})"
    return text


# fixed values: Wichura's algorithm AS 241 (1988) for normal quantiles, lowest power first
QUANTILE_MIDDLE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
     3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
QUANTILE_TAIL = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)


def sql_upper_quantile(p: str) -> str:
    """Normal value above which a share ``p`` of at most one half lies (p > 1e-11)."""
    q = f"(0.5 - {p})"
    r = f"(0.180625 - {q} * {q})"
    tail = f"(sqrt(-ln({p})) - 1.6)"
    middle = f"{q} * {_sql_poly(QUANTILE_MIDDLE[0], r)} / {_sql_poly(QUANTILE_MIDDLE[1], r)}"
    far = f"{_sql_poly(QUANTILE_TAIL[0], tail)} / {_sql_poly(QUANTILE_TAIL[1], tail)}"
    return f"CASE WHEN {q} <= 0.425 THEN {middle} ELSE {far} END"


def sql_shapiro() -> str:
    """CTEs ending in ``shapiro`` ("column", gk, w, p), from ``cells`` and ``stats``.

    Royston's AS R94 for groups of 20 and more values.
    """
    last = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
    following = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    mean = _sql_poly([-1.5861, -0.31082, -0.083751, 0.0038915], "ln(n)")
    spread = f"exp({_sql_poly([-0.4803, -0.082676, 0.0030302], 'ln(n)')})"
    tail = sql_gamma_tail("0.5", "z * z / 2")
    return f"""
        ranked AS (
            SELECT c."column", c.gk, value, n, vp,
                row_number() OVER (PARTITION BY c."column", c.gk ORDER BY value) AS i
            FROM cells c JOIN stats s ON c."column" = s."column" AND c.gk = s.gk
            WHERE sd > 0),
        halves AS (
            SELECT a."column", a.gk, a.n, a.vp, a.i, b.value - a.value AS d,
                (a.i - 0.375) / (a.n + 0.25) AS share
            FROM ranked a JOIN ranked b ON a."column" = b."column" AND a.gk = b.gk AND b.i = a.n + 1 - a.i
            WHERE a.i <= a.n // 2),
        scores AS (SELECT *, {sql_upper_quantile("share")} AS m FROM halves),
        norms AS (
            SELECT "column", gk, 2 * sum(m * m) AS norm2, max(m) FILTER (WHERE i = 1) AS m1,
                max(m) FILTER (WHERE i = 2) AS m2, 1 / sqrt(any_value(n)) AS u
            FROM scores GROUP BY ALL),
        ends AS (
            SELECT *, {_sql_poly(last, "u")} + m1 / sqrt(norm2) AS a1,
                {_sql_poly(following, "u")} + m2 / sqrt(norm2) AS a2 FROM norms),
        ratio AS (
            SELECT s."column", s.gk, any_value(n) AS n,
                pow(sum(d * CASE i WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE m
                    / sqrt((norm2 - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END), 2)
                    / (any_value(vp) * any_value(n)) AS w
            FROM scores s JOIN ends e ON s."column" = e."column" AND s.gk = e.gk
            GROUP BY s."column", s.gk),
        standard AS (SELECT *, (ln(1 - w) - {mean}) / {spread} AS z FROM ratio),
        shapiro AS (
            SELECT "column", gk, w, CASE WHEN z > 0 THEN 0.5 * ({tail}) ELSE 1 - 0.5 * ({tail}) END AS p
            FROM standard)"""
