"""File kinds and data set metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: kinds by extension, and the marks of a first line
KINDS = {
    "tabular": [".csv", ".tsv", ".txt"],
    "sequence": [".fasta", ".fa", ".fna", ".ffn", ".faa", ".frn"],
    "json": [".json"],
    "variant": [".vcf"],
}
VARIANT_MARK = "##fileformat=VCF"


def _kind_by_name(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    kind = F.lit(None).cast("string")
    for name, extensions in KINDS.items():
        kind = F.when(extension.isin(extensions), name).otherwise(kind)
    return kind


def _kind_by_line(line: Column) -> Column:
    text = F.trim(line)
    return (
        F.when(text.startswith(">"), "sequence")
        .when(text.startswith(VARIANT_MARK), "variant")
        .when(F.contains(text, F.lit(",")) | F.contains(text, F.lit("\t")), "tabular")
        .otherwise("unknown")
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime); file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )


def detect_file_types(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type) by extension, else by the first line.

    Spark's scans leave out empty files, its listing does not; that is one name for each
    file and on the driver anyway.
    """
    place = F.col("_metadata.file_path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    # as the metadata column spells paths without a host
    files = spark.createDataFrame([(re.sub(r"^([^:/]+):///", r"\1:/", name),) for name in listed], "path string")
    files = files.withColumn("_kind", _kind_by_name(F.col("path")))
    # only files whose name says nothing are opened; a first line is in the first split
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    unnamed = lines.filter(_kind_by_name(place).isNull() & (F.col("_metadata.file_block_start") == 0))
    starts = unnamed.select(place.alias("path"), "value").withColumn("_i", F.monotonically_increasing_id())
    first = starts.groupBy("path").agg(F.min_by("value", "_i").alias("_line"))
    return files.join(first, "path", "left").select(
        "path",
        F.coalesce("_kind", _kind_by_line(F.coalesce("_line", F.lit("")))).alias("file_type"),
    )


def dataset_metadata(df: DataFrame) -> DataFrame:
    """Per file of a file-based frame its size, time, row and column count."""
    files = df.groupBy(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_date"),
    ).agg(F.count("*").alias("row_count"))
    names = F.array(*[F.lit(c) for c in df.columns])
    kinds = F.create_map(
        *[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]
    )
    return files.select(
        "*",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(True).alias("has_headers"),
        names.alias("column_names"),
        kinds.alias("column_types"),
    )
