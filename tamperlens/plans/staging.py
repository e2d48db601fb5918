"""Written tables that cut lineage, and sorted tables that carry positions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.session import shared_folder

BLOCK = "_block"
SEQ = "_seq"
_SEQ_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def active_session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one result feeds several branches: the branches then read columns
    they need from one table whose size Catalyst knows, and a lost executor
    costs a re-read, not a re-computation that might order ties differently.
    """
    spark = active_session(df)
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


class Sizes(NamedTuple):
    """Rows of all keys together, and of the largest key."""

    total: int
    largest: int


def stage_observed(df: DataFrame, **measures: str) -> tuple[DataFrame, dict]:
    """:func:`stage`, with aggregates of the rows taken while they are written."""
    seen = Observation()
    staged = stage(df.observe(seen, *[F.expr(sql).alias(name) for name, sql in measures.items()]))
    return staged, seen.get


def stage_keys(per_key: DataFrame, rows: str) -> tuple[DataFrame, Sizes]:
    """Stage a table of one row per key whose ``rows`` counts its facts, and sum it up.

    The sums are observed on the write, so no job runs for them. A task that is run again
    can only make them larger than they are, which choices by size bear.
    """
    count = quoted(rows)
    staged, seen = stage_observed(per_key, total=f"sum({count})", largest=f"max({count})")
    return staged, Sizes(int(seen["total"] or 0), int(seen["largest"] or 0))


def clear_staged(spark: SparkSession) -> None:
    """Delete every table this application staged; results built on them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_sorted(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Range-sorted staged copy with ``_block`` (partition) and ``_seq`` (order).

    ``_seq`` rises along the total order, ``_block`` is the written partition, so
    a block holds one task's share of the sort no matter how keys are skewed.
    """
    order = [F.col(quoted(c)) if isinstance(c, str) else c for c in order_by]
    ordered = df.orderBy(*order).withColumn(SEQ, F.monotonically_increasing_id())
    return stage(ordered.withColumn(BLOCK, F.shiftright(F.col(SEQ), _SEQ_BITS)))


def with_row_id(
    df: DataFrame, order_by: Sequence[str | Column], row_id: str = "row_id"
) -> DataFrame:
    """B1: dense 0-based position of every row in the given total order.

    One range sort, written once; the partition sizes (one row per written
    partition) give the offsets, so no window ever spans the whole table.
    """
    staged = stage_sorted(df, order_by)
    sizes = staged.groupBy(BLOCK).agg(F.count("*").alias("n")).orderBy(BLOCK).collect()
    starts, total = [], 0
    for block, n in sizes:
        starts.append((block, total - (block << _SEQ_BITS)))
        total += n
    if len(starts) <= 1:
        shift = starts[0][1] if starts else 0
        numbered = staged.withColumn(row_id, F.col(SEQ) + F.lit(shift).cast("bigint"))
    else:
        # one row per written partition: bounded by the shuffle partition count
        offsets = active_session(df).createDataFrame(starts, f"{BLOCK} bigint, _shift bigint")
        numbered = staged.join(F.broadcast(offsets), BLOCK).withColumn(
            row_id, F.col(SEQ) + F.col("_shift")
        )
    return numbered.selectExpr(*[quoted(c) for c in [row_id, *df.columns]])


def partition_by(keys: Sequence[str]) -> str:
    """PARTITION BY clause; empty without keys."""
    return f"PARTITION BY {', '.join(quoted(k) for k in keys)}" if keys else ""


def running_total(staged: DataFrame, keys: Sequence[str], amount: str, out: str) -> DataFrame:
    """Inclusive running sum of ``amount`` inside ``keys`` along a staged sort.

    Local sums run inside (keys, block); block totals, at most one per written
    partition and key, carry the sum from block to block.
    """
    names = ", ".join(quoted(k) for k in [*keys, BLOCK])
    totals = staged.groupBy(*keys, BLOCK).agg(F.sum(amount).alias("_total"))
    bases = totals.selectExpr(
        *[quoted(k) for k in [*keys, BLOCK]],
        f"coalesce(sum(_total) OVER ({partition_by(keys)} ORDER BY {BLOCK} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _base",
    )
    local = f"sum({quoted(amount)}) OVER (PARTITION BY {names} ORDER BY {SEQ})"
    return (
        staged.selectExpr("*", f"{local} AS _local")
        .join(bases, [*keys, BLOCK])
        .withColumn(out, F.expr("_base + _local"))
        .drop("_base", "_local")
    )


def along_order(
    staged: DataFrame, keys: Sequence[str], amount: str, value: str, upto: str, before: str
) -> DataFrame:
    """:func:`running_total` of ``amount`` and :func:`previous_in_order` of ``value`` in one pass.

    Both look inside (keys, block) by one window, and one table of blocks carries them on.
    """
    names = [quoted(k) for k in [*keys, BLOCK]]
    here = f"(PARTITION BY {', '.join(names)} ORDER BY {SEQ})"
    blocks = staged.groupBy(*keys, BLOCK).agg(F.sum(amount).alias("_total"), F.max_by(value, SEQ).alias("_last"))
    along = f"({partition_by(keys)} ORDER BY {BLOCK})"
    carried = blocks.selectExpr(
        *names, f"sum(_total) OVER {along} - _total AS _base", f"lag(_last) OVER {along} AS _carry"
    )
    return (
        staged.selectExpr(
            "*", f"sum({quoted(amount)}) OVER {here} AS _local", f"row_number() OVER {here} AS _n",
            f"lag({quoted(value)}) OVER {here} AS _prev",
        )
        .join(carried, [*keys, BLOCK])
        .withColumns({upto: F.expr("_base + _local"), before: F.expr("if(_n = 1, _carry, _prev)")})
        .drop("_base", "_local", "_n", "_prev", "_carry")
    )


def previous_in_order(staged: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Value of the preceding row inside ``keys`` along a staged sort.

    Blocks look back inside themselves; the first row of a block takes the last
    value of the block before it.
    """
    names = [quoted(k) for k in [*keys, BLOCK]]
    here = f"(PARTITION BY {', '.join(names)} ORDER BY {SEQ})"
    lasts = staged.groupBy(*keys, BLOCK).agg(F.max_by(value, SEQ).alias("_last"))
    carried = lasts.selectExpr(
        *names, f"lag(_last) OVER ({partition_by(keys)} ORDER BY {BLOCK}) AS _carry"
    )
    looked = staged.selectExpr(
        "*", f"row_number() OVER {here} AS _n", f"lag({quoted(value)}) OVER {here} AS _prev"
    )
    return (
        looked.join(carried, [*keys, BLOCK])
        .withColumn(out, F.expr("if(_n = 1, _carry, _prev)"))
        .drop("_n", "_prev", "_carry")
    )
