"""Staged tables, connected components and unit blocks shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], stem: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def bounded_batches(spark: SparkSession, most_bytes: int = 1 << 23) -> None:
    """Bound the Arrow batches of the session in bytes, unless it sets a bound itself.

    Batches are else bounded in rows only, and ten thousand long texts fill a worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most_bytes))


def parts_by_size(df: DataFrame, bytes_per_part: int = 1 << 25) -> list[int]:
    """Leading argument for a range partitioning of ``df``, or none where the session's will do.

    The session's number of partitions suits one size of input; where Catalyst's estimate
    from the files asks for more, so many are named.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = math.ceil(size / bytes_per_part)
    known = size < 1 << 56  # inputs without files have no estimate
    return [wanted] if known and wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


class Scratch:
    """Parquet tables in the shared folder of the session, dropped when no longer read.

    A staged table cuts lineage: a lost executor re-reads it.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = (
            f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"
        )

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of (a, b) long pairs: rows (node, component = smallest node).

    Alternating large-star and small-star steps over staged edge tables; each step
    keeps at most as many edges as it read, and a star's centre is met through its
    minimum (a partial aggregate) and one equi-join, never through a collected list.
    Empty input gives no rows.
    """
    current = scratch.stage(
        edges.where("a <> b")
        .selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo")
        .distinct(),
        f"{name}-0",
    )
    step = 0
    while True:
        both = current.selectExpr("hi AS u", "lo AS v").unionAll(current.selectExpr("lo AS u", "hi AS v"))
        # large star: every larger neighbour is hung under the smallest one
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct()
        # small star: the node and its smaller neighbours are hung under the smallest one
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(small_least, "hi")
            .selectExpr("explode(array(struct(hi, m AS lo), struct(lo AS hi, m AS lo))) AS e")
            .selectExpr("e.hi AS hi", "e.lo AS lo")
            .where("hi <> lo")
            .distinct()
        )
        step += 1
        following = scratch.stage(small, f"{name}-{step}")
        if _same_edges(current, following):
            scratch.drop(f"{name}-{step - 1}")
            break
        scratch.drop(f"{name}-{step - 1}")
        current = following
    stars = following
    return stars.selectExpr("hi AS node", "lo AS component").unionAll(
        stars.select("lo").distinct().selectExpr("lo AS node", "lo AS component")
    )


def _same_edges(a: DataFrame, b: DataFrame) -> bool:
    def digest(df):
        return df.selectExpr(
            "count(*) AS n", "coalesce(bit_xor(xxhash64(hi, lo)), 0) AS x",
            "coalesce(sum(CAST(xxhash64(lo, hi) AS DECIMAL(38,0))), 0) AS s",
        ).first()

    return digest(a) == digest(b)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def unit_rows(sizes: DataFrame, per_block: int) -> int:
    """Rows that :func:`block_pairs` makes of groups of the given sizes (column n)."""
    found = sizes.selectExpr(f"sum(CAST(n * ceil(n / {float(per_block)}D) AS DECIMAL(38,0))) AS rows").first()
    return int(found.rows or 0)


def block_pairs(members: DataFrame, sizes: DataFrame, key: str, member: str, per_block: int) -> DataFrame:
    """Spread each group over pairs of bounded blocks.

    ``members`` has (key, member …), ``sizes`` (key, n). A group of n members is cut
    into ceil(n / per_block) blocks by a hash of the member, and each member goes to
    every pair of blocks that holds its own: columns ``block_i`` <= ``block_j`` and
    ``block`` (its own). Any two members meet in exactly one unit, apart from the two
    of one block, which meet as such in the unit (i, i) only.
    """
    return (
        members.join(sizes, key)
        .withColumn("_blocks", F.ceil(F.col("n") / F.lit(float(per_block))).cast("int"))
        .withColumn("block", F.expr(f"CAST(pmod(xxhash64({member}, 77), _blocks) AS INT)"))
        .withColumn("_other", F.expr("explode(sequence(0, _blocks - 1))"))
        .withColumn("block_i", F.expr("least(block, _other)"))
        .withColumn("block_j", F.expr("greatest(block, _other)"))
        .drop("_blocks", "_other")
    )
