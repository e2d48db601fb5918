"""Staging, row numbers, skew-safe joins, block windows, quantiles and plan shapes."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tamperlens.operators.digits import terminal_digits
from tamperlens.operators.inliers import inlier_bands
from tamperlens.operators.profile import listed_values
from tamperlens.plans.blocks import fits_window, over_neighbours, position_in_group
from tamperlens.plans.joins import attach_by_key, join_spread
from tamperlens.plans.limits import Limits
from tamperlens.plans.quantiles import grouped_quantiles
from tamperlens.plans.staging import (
    clear_staged,
    previous_in_order,
    running_total,
    stage,
    stage_sorted,
    with_row_id,
)
from tamperlens.session import shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_row_id_is_dense_and_ordered(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k")).repartition(16)
    rows = with_row_id(df, ["k"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(10_000))
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys)


def test_row_id_of_nothing(spark):
    assert with_row_id(spark.range(0), ["id"]).count() == 0


def test_row_id_ignores_input_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") * 31 % 503).alias("k"))
    assert same_rows(with_row_id(df.repartition(7), ["k"]), with_row_id(df.repartition(3), ["k"]))


def test_both_quantile_plans_give_equal_bits(spark):
    df = spark.range(997 * 60).selectExpr("id % 997 AS k", "rand(3) * 1000 AS v")
    wanted = {"q25": 0.25, "median": 0.5, "q90": 0.9}
    plans = [
        grouped_quantiles(df, ["k"], "v", wanted, 100, limits).orderBy("k").collect()
        for limits in (Limits(), Limits(percentile_rows=1, hot_rows=50, spread=4))
    ]
    assert plans[0] == plans[1]


def test_staged_tables_live_in_the_session_folder(spark):
    staged = stage(spark.range(5))
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert all(folder in f for f in staged.inputFiles())


def _hot(spark):
    """A third of the rows on one key."""
    return spark.range(300).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
    )


def test_attach_by_key_keeps_hot_rows_in_place_without_changing_rows(spark, tiny):
    facts = _hot(spark).union(spark.createDataFrame([(900, None), (901, None)], "row_id bigint, k string"))
    stats = stage(facts.filter("k IS NOT NULL AND k <> 'k7'").groupBy("k").agg(F.count("*").alias("n")))
    plain = attach_by_key(facts, stats, ["k"], "n")
    spread = attach_by_key(facts, stats, ["k"], "n", Limits(hot_rows=50, spread=4))
    assert same_rows(plain, spread)
    assert same_rows(plain, attach_by_key(facts, stats, ["k"], "n", tiny))
    # the hot branch meets its results where its rows are: the only shuffle serves the rest
    text = spread._jdf.queryExecution().sparkPlan().toString()
    assert "LeftAnti" in text and "LeftAnti" not in plan(plain)


def test_hot_key_broadcast_is_bounded(spark):
    """However many rows there are, at most max_hot_keys keys pass the threshold."""
    stats = stage(spark.range(100).select(F.col("id").alias("k"), F.lit(10).cast("bigint").alias("n")))
    facts = spark.range(100).select(F.col("id").alias("k"))
    joined = attach_by_key(facts, stats, ["k"], "n", limits=Limits(hot_rows=1, max_hot_keys=10))
    # each key owns a hundredth of the rows, so none may be broadcast as hot
    assert "LeftAnti" not in plan(joined)


def test_join_spread_equals_join(spark):
    facts = _hot(spark)
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3)], "k string, v int")
    assert same_rows(join_spread(facts, few, ["k"], "row_id", 5), facts.join(few, "k"))


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_positions_and_neighbours_by_block(spark, block):
    df = _hot(spark)

    def columns(window):
        return {
            "l": f"lag(row_id) OVER ({window})",
            "near": f"collect_list(row_id) OVER ({window} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
        }

    def run(size):
        placed = position_in_group(df, ["k"], "row_id", "p", size)
        return over_neighbours(placed, ["k"], "p", 2, columns, size)

    assert same_rows(run(None), run(block))


def test_strategy_name_is_checked(spark):
    with pytest.raises(ValueError):
        fits_window(spark.range(1), ["id"], Limits(), "other")


def test_running_total_and_previous_across_blocks(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    staged = stage_sorted(df.repartition(9), ["k", "v"])
    staged = staged.withColumn("_block", F.expr("_seq div 17"))  # many blocks per key
    total = running_total(staged, ["k"], "v", "t").select("k", "v", "t")
    window = "sum(v) OVER (PARTITION BY k ORDER BY v) AS t"
    assert same_rows(total, df.selectExpr("k", "v", window))
    before = previous_in_order(staged, ["k"], "v", "b").select("k", "v", "b")
    assert same_rows(before, df.selectExpr("k", "v", "lag(v) OVER (PARTITION BY k ORDER BY v) AS b"))


def test_quantiles_both_ways(spark, tiny):
    rng = np.random.default_rng(5)
    values = [(f"g{i % 3}", float(v)) for i, v in enumerate(rng.normal(size=301).round(1))]
    df = spark.createDataFrame(values, "g string, v double")
    wanted = {"a": 0.25, "b": 0.5, "c": 0.9}
    short = grouped_quantiles(df, ["g"], "v", wanted, 101)
    long = grouped_quantiles(df, ["g"], "v", wanted, 101, tiny)
    assert same_rows(short, long)
    for row in short.collect():
        mine = [v for g, v in values if g == row["g"]]
        assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(mine, [0.25, 0.5, 0.9])))


def test_digits_read_only_their_columns(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(terminal_digits(lines, ["l_quantity"]))
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert schema.startswith("struct<l_quantity:double>")


def test_digits_shuffle_only_counts(spark, sf_dir):
    """Cells are counted before the exchange, so it carries one row per column and task."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(terminal_digits(lines)).split("== Physical Plan ==")[1]
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text.split("Exchange hashpartitioning")[1]


def test_value_listing_limits_before_the_shuffle(spark, sf_dir):
    text = plan(listed_values(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    assert "WindowGroupLimit" in text


def test_inlier_statistics_are_broadcast_when_small(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = plan(inlier_bands(events, ["value"], "event_type"))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_staged_tables_can_be_cleared(spark):
    staged = stage(spark.range(3))
    assert staged.count() == 3
    path = staged.inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(path)
    clear_staged(spark)
    assert not os.path.exists(path)
