"""Archived analyses: report texts with ratings and embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: rating mark, block fences, bands and picture files
RATING_PATTERN = r"MANIPULATION_RATING:\s*(\d+)"
JSON_BLOCK = r"(?s)```json\n(.*?)\n```"
HIGH_BAND, MIDDLE_BAND = 8, 5
PICTURES = "*.{png,jpg,jpeg,svg}"
INFO_FILE = "analysis_info.json"

FINDINGS_SCHEMA = "array<struct<type: string, details: string>>"


def manipulation_rating(text: Column) -> Column:
    """Rating stated in a report, NULL without one."""
    found = F.regexp_extract(text, RATING_PATTERN, 1)
    return F.when(found != "", found).try_cast("int")


def rating_band(rating: Column) -> Column:
    return F.when(rating >= HIGH_BAND, "high").when(rating >= MIDDLE_BAND, "middle").when(
        rating.isNotNull(), "low"
    )


def report_ratings(reports: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """Analyses newest first, with date, rating, band and picture count.

    ``reports`` has (id, timestamp in seconds, report text); ``pictures`` has one
    row per picture with its analysis ``id``.
    """
    rated = reports.withColumn("manipulation_rating", manipulation_rating(F.col("report"))).withColumn(
        "rating_band", rating_band(F.col("manipulation_rating"))
    )
    dated = rated.withColumn(
        "date", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss")
    )
    if pictures is None:
        counted = dated.withColumn("visualization_count", F.lit(0).cast("bigint"))
    else:
        counts = pictures.groupBy("id").agg(F.count("*").alias("visualization_count"))
        counted = dated.join(counts, "id", "left").withColumn(
            "visualization_count", F.coalesce("visualization_count", F.lit(0).cast("bigint"))
        )
    return counted.drop("report").orderBy(F.desc("timestamp"), "id")


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_reports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(reports, pictures) of an archive with one sub-folder per analysis."""
    info = (
        spark.read.schema("id string, filename string, timestamp double, report_filename string")
        .option("multiLine", True)
        .json(f"{folder}/*/{INFO_FILE}")
        .withColumn("_folder", _folder(F.col("_metadata.file_path")))
    )
    texts = spark.read.text(f"{folder}/*/*.md", wholetext=True).select(
        _folder(F.col("_metadata.file_path")).alias("_folder"),
        F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("report_filename"),
        F.col("value").alias("report"),
    )
    reports = info.join(texts, ["_folder", "report_filename"], "left").drop("_folder")
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", PICTURES)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    pictures = found.select(_folder(F.col("path")).alias("id"), "path")
    return reports, pictures


def extract_json_blocks(df: DataFrame, text: str) -> DataFrame:
    """Column roles and findings from the first two fenced JSON blocks.

    Adds ``columns`` (map of role to JSON list), ``findings``, ``column_count`` and
    ``finding_count``; all NULL below two blocks, a block that is bad JSON counts
    as empty.
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit(JSON_BLOCK), F.lit(1))
    found = df.withColumn("_b", F.when(F.size(blocks) >= 2, blocks))
    columns = F.from_json(F.get("_b", F.lit(0)), "map<string,string>")
    findings = F.from_json(F.get("_b", F.lit(1)), FINDINGS_SCHEMA)
    lists = F.filter(F.map_values("columns"), lambda v: F.startswith(v, F.lit("[")))
    listed = F.aggregate(lists, F.lit(0), lambda n, v: n + F.coalesce(F.json_array_length(v), F.lit(0)))
    known = F.col("_b").isNotNull()
    return (
        found.withColumn("columns", columns)
        .withColumn("findings", findings)
        .withColumn("column_count", F.when(known, F.coalesce(listed, F.lit(0))))
        .withColumn(
            "finding_count",
            F.when(known, F.when(F.col("findings").isNull(), 0).otherwise(F.size("findings"))),
        )
        .drop("_b")
    )
