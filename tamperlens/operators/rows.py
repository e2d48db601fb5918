"""Row identity, row lists, sampling and column roles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperlens.functions.columns import is_numeric, quoted, require_columns
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.staging import stage, stage_observed, with_row_id

__all__ = [
    "column_roles",
    "flag_rows",
    "head_sample",
    "parse_row_spec",
    "preview_columns",
    "random_sample",
    "role_of",
    "rows_frame",
    "split_suspicious",
    "with_row_id",
]

SINGLE_ROW = r"^\s*\+?[0-9]+\s*$"
ROW_RANGE = r"^\s*\+?[0-9]+\s*-\s*\+?[0-9]+\s*$"
_PIECE = 100_000  # longest array one exploded range piece builds


def rows_frame(spark: SparkSession, rows: DataFrame | Iterable[int]) -> DataFrame:
    """Distinct row numbers as one ``row_index`` column.

    A frame is staged: its size is known from then on, so joins against a short
    list become broadcasts, and whatever found the rows does not run again.
    """
    if isinstance(rows, DataFrame):
        require_columns(rows, ["row_index"])
        return stage(rows.select(F.col("row_index").cast("bigint")).distinct())
    return spark.createDataFrame([(int(r),) for r in set(rows)], "row_index bigint")


def parse_row_spec(df: DataFrame, spec: str, out: str = "row_index") -> DataFrame:
    """B2: ``"12, 45-50"`` to one row per number; other columns are kept.

    Malformed parts and reversed ranges give nothing, repeated numbers stay.
    Long ranges are cut into pieces before they are unfolded.
    """
    parts = df.withColumn("_part", F.explode(F.split(spec, ","))).withColumn(
        "_part", F.trim("_part")
    )
    single = F.col("_part").rlike(SINGLE_ROW)
    ranged = F.col("_part").rlike(ROW_RANGE)
    bounds = F.split("_part", "-")
    low = F.when(single, F.col("_part")).when(ranged, bounds[0])
    high = F.when(single, F.col("_part")).when(ranged, F.get(bounds, F.lit(1)))
    limited = (
        parts.filter(single | ranged)
        .withColumn("_lo", F.trim(low).try_cast("bigint"))
        .withColumn("_hi", F.trim(high).try_cast("bigint"))
        .filter(F.col("_lo") <= F.col("_hi"))
    )
    pieces = limited.withColumn(
        "_start", F.explode(F.sequence("_lo", "_hi", F.lit(_PIECE).cast("bigint")))
    )
    last = F.least(F.col("_start") + (_PIECE - 1), F.col("_hi"))
    numbers = pieces.withColumn(out, F.explode(F.sequence(F.col("_start"), last)))
    return numbers.select(*df.columns, out)


def _row_marks(rows: DataFrame) -> tuple[DataFrame, int]:
    """Staged (_block, _words), one bit for each of 4096 row numbers, and the number of blocks."""
    require_columns(rows, ["row_index"])
    listed = rows.select(F.col("row_index").cast("bigint")).filter("row_index IS NOT NULL")
    bits = (
        listed.repartition(F.expr("shiftright(row_index, 12)"))
        .selectExpr(
            "shiftright(row_index, 12) AS _block",
            "shiftright(row_index, 6) & 63 AS _word",
            "shiftleft(1L, CAST(row_index & 63 AS INT)) AS _bit",
        )
        .groupBy("_block", "_word")
        .agg(F.expr("bit_or(_bit) AS _bits"))
    )
    words = "transform(sequence(0L, 63L), i -> coalesce(_known[i], 0L)) AS _words"
    marks, seen = stage_observed(
        bits.groupBy("_block")
        .agg(F.expr("map_from_entries(collect_list(struct(_word, _bits))) AS _known"))
        .selectExpr("_block", words),
        blocks="count(*)",
    )
    return marks, seen["blocks"]


def flag_rows(
    df: DataFrame,
    rows: DataFrame | Iterable[int],
    row_id: str = "row_id",
    flag: str = "is_suspicious",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Boolean column telling listed rows from the others.

    A frame of rows becomes one bit for each row number, so that the listed rows
    travel to the table, which stays where it is.
    """
    require_columns(df, [row_id])
    columns = [quoted(c) for c in df.columns]
    if isinstance(rows, DataFrame) and isinstance(df.schema[row_id].dataType, T.IntegralType):
        marks, blocks = _row_marks(rows)
        row = f"CAST({quoted(row_id)} AS BIGINT)"
        marked = df.withColumn("_block", F.expr(f"shiftright({row}, 12)")).join(
            F.broadcast(marks) if blocks <= limits.mark_blocks else marks, "_block", "left"
        )
        bit = f"getbit(_words[CAST(shiftright({row}, 6) & 63 AS INT)], CAST({row} & 63 AS INT))"
        return marked.selectExpr(*columns, f"coalesce({bit} = 1, false) AS {quoted(flag)}")
    listed = rows_frame(df.sparkSession, rows).selectExpr(
        f"row_index AS {quoted(row_id)}", f"true AS {quoted(flag)}"
    )
    known = f"coalesce({quoted(flag)}, false) AS {quoted(flag)}"
    return df.join(listed, row_id, "left").selectExpr(*columns, known)


def split_suspicious(
    df: DataFrame, rows: DataFrame | Iterable[int], row_id: str = "row_id"
) -> dict[str, DataFrame]:
    """The three data sets compared by the effect checks."""
    listed = rows_frame(df.sparkSession, rows).select(F.col("row_index").alias(row_id))
    return {
        "full_dataset": df,
        "without_suspicious": df.join(listed, row_id, "left_anti"),
        "suspicious_only": df.join(listed, row_id, "left_semi"),
    }


def head_sample(df: DataFrame, n: int = 5, row_id: str = "row_id") -> DataFrame:
    """The first n rows in row order."""
    return df.orderBy(row_id).limit(n)


def random_sample(
    df: DataFrame, n: int = 100, seed: int = 0, key: Sequence[str] | None = None
) -> DataFrame:
    """N rows without replacement; with ``key`` the choice is repeatable.

    Both forms are a top-n, so each task keeps n rows and only those travel.  The
    repeatable choice goes by MD5, which other engines compute alike.
    """
    if key is None:
        return df.orderBy(F.rand(seed)).limit(n)
    named = [F.col(k).cast("string") for k in key]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *named)), *key).limit(n)


# fixed values: name parts that mark a column's role
ROLE_PARTS = {
    "id": ["id", "participant", "subject", "case"],
    "group": ["group", "condition", "treatment"],
    "outcome": ["score", "result", "outcome", "dependent"],
}


def role_of(name: Column, role: str) -> Column:
    """True where the column name carries a part of the role."""
    matched = F.lit(False)
    for part in ROLE_PARTS[role]:
        matched = matched | F.lower(name).contains(part)
    return matched


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column with its position, type and role flags.

    Only the schema is read; a name may match several roles.
    """
    listing = df.sparkSession.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), is_numeric(f.dataType))
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column string, dtype string, is_numeric boolean",
    )
    return listing.select(
        "*", *[role_of(F.col("column"), role).alias(f"is_{role}") for role in ROLE_PARTS]
    )


def _named_like(df: DataFrame, role: str) -> list[str]:
    return [c for c in df.columns if any(part in c.lower() for part in ROLE_PARTS[role])]


def preview_columns(df: DataFrame, issue: str, flagged: Sequence[str] = ()) -> list[str]:
    """The columns worth showing next to findings of one kind."""
    ids = _named_like(df, "id")
    if issue == "sorting_anomaly":
        chosen = ids + list(flagged)
    elif issue == "duplicate_id":
        chosen = ids[:1] + [c for c in df.columns if c not in ids][:3]
    elif issue == "statistical_anomaly":
        chosen = ids[:1] + list(flagged)
    elif issue == "excel_movement":
        chosen = ids[:1] + _named_like(df, "group")[:2] + _named_like(df, "outcome")[:2]
    else:
        chosen = []
    return list(dict.fromkeys(chosen)) or df.columns[:5]
