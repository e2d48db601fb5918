"""Sequence and variant files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.sources.tabular import typed

FIRST_BASES = 50


def _body():
    """Everything after the header line; an empty text where there is none."""
    start = F.instr(F.col("_record"), "\n")
    return F.when(start > 0, F.substr(F.col("_record"), start + 1)).otherwise(F.lit(""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, description, length, first_bases, sequence), one row per record.

    Records are cut at line starts with ``>``, so large files split across tasks.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"^>", "")
    header = F.regexp_replace(F.substring_index(record, "\n", 1), r"\r$", "")
    return (
        records.select(F.col("_metadata.file_path").alias("path"), record.alias("_record"), header.alias("description"))
        .filter(F.trim("description") != "")
        .withColumn("sequence", F.regexp_replace(_body(), r"\s+", ""))
        .select(
            "path",
            F.split("description", r"\s+")[0].alias("id"),
            "description",
            F.length("sequence").alias("length"),
            F.substring("sequence", 1, FIRST_BASES).alias("first_bases"),
            "sequence",
        )
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant lines with the column names of each file's own ``#CHROM`` line.

    Files of one header are read together; files without one are an error.
    """
    lines = spark.read.text(path).selectExpr(
        "_metadata.file_path AS file", "value", "(_metadata.file_block_start, monotonically_increasing_id()) AS place"
    )
    heads = (
        lines.groupBy("file")
        .agg(F.expr("min_by(value, place) FILTER (WHERE rtrim('\r', value) RLIKE '^#CHROM(\t|$)') AS head"))
        .collect()  # one row for each file
    )
    lost = [unquote(r.file) for r in heads if r.head is None]
    if lost or not heads:
        raise ValueError(f"no header line in {', '.join(lost) or path}")
    table = None
    for head in sorted({r.head for r in heads}):
        files = [unquote(r.file) for r in heads if r.head == head]
        names = head.lstrip("#").rstrip("\r").split("\t")
        fields = ", ".join(f"{quoted(n)} string" for n in names)
        rows = spark.read.schema(fields).csv(files, sep="\t", comment="#", quote="")
        table = rows if table is None else table.unionByName(rows, allowMissingColumns=True)
    return typed(table)
