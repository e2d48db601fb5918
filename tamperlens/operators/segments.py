"""Consecutive row segments, caller-supplied scorers and their roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamperlens.functions.columns import long_form, numeric_columns, present_columns

# fixed values: segment sizes and report bounds
MAX_ROWS, MIN_ROWS, PARTS, ONE_PIECE = 500, 50, 10, 1000
HIGH_CONFIDENCE = 7
LISTED_ROWS = 10
PARSE_ERROR = "no readable JSON object in the response"

RESPONSE_SCHEMA = (
    "anomalies_detected boolean, confidence string, explanation string, error string, "
    "findings array<struct<type: string, description: string, severity: string, "
    "row_indices: array<bigint>, columns_involved: array<string>>>"
)


def segment_size(total: Column, max_rows: int = MAX_ROWS, parts: int = PARTS) -> Column:
    """Rows per segment for a table of ``total`` rows."""
    tenth = F.floor(total / F.lit(parts))
    wanted = F.when(total <= ONE_PIECE, total).otherwise(tenth)
    return F.greatest(F.lit(MIN_ROWS), F.least(wanted, F.lit(max_rows))).cast("bigint")


def assign_segments(
    df: DataFrame,
    row_id: str = "row_id",
    max_rows: int = MAX_ROWS,
    max_chunks: int | None = None,
) -> DataFrame:
    """H1: add ``chunk`` (from 1) and ``rows`` ("start-end", end exclusive).

    Every row gets a segment; ``max_chunks`` keeps the first segments only.
    """
    total = df.agg(F.max(row_id) + 1).scalar()
    size = segment_size(total, max_rows, max_chunks or PARTS)
    chunked = df.withColumn("_size", size).withColumn(
        "chunk", F.floor(F.col(row_id) / F.col("_size")).cast("bigint") + 1
    )
    if max_chunks is not None:
        chunked = chunked.filter(F.col("chunk") <= max_chunks)
    start = (F.col("chunk") - 1) * F.col("_size")
    end = F.least(start + F.col("_size"), total)
    label = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return chunked.withColumn("rows", label).drop("_size")


def segment_bounds(segments: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(chunk, rows, start_row, end_row, n) of assigned segments."""
    return segments.groupBy("chunk", "rows").agg(
        F.min(row_id).alias("start_row"),
        F.max(row_id).alias("last_row"),
        F.count("*").alias("n"),
    )


def segment_describe(
    segments: DataFrame, columns: Sequence[str] | None = None, row_id: str = "row_id"
) -> DataFrame:
    """H2: count, mean, deviation and quartiles of numeric columns per segment.

    A segment holds at most ``max_rows`` rows, so the exact percentile is safe.
    """
    if columns is None:
        names = numeric_columns(segments, exclude=[row_id, "chunk"])
    else:
        names = numeric_columns(segments, present_columns(segments, columns))
    cells = long_form(segments, names, ["chunk"])
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    described = cells.groupBy("chunk", "column").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        quartiles.alias("_q"),
        F.max("value").alias("max"),
    )
    return described.select(
        "chunk",
        "column",
        "count",
        "mean",
        "std",
        "min",
        F.col("_q")[0].alias("q25"),
        F.col("_q")[1].alias("q50"),
        F.col("_q")[2].alias("q75"),
        "max",
    )


def segment_apply(
    segments: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
) -> DataFrame:
    """H3: run ``scorer`` on every segment; a failing segment yields an error row.

    The result has ``chunk``, ``rows``, the scorer's columns and ``error``.
    """
    inner = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fixed = [T.StructField("chunk", T.LongType()), T.StructField("rows", T.StringType())]
    full = T.StructType([*fixed, *inner.fields, T.StructField("error", T.StringType())])
    names = [f.name for f in inner.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, rows = pdf["chunk"].iloc[0], pdf["rows"].iloc[0]
        try:
            scored = scorer(pdf)[names].assign(error=None)
        except Exception as failure:  # one bad segment must not end the job
            scored = pd.DataFrame([{**dict.fromkeys(names), "error": str(failure)}])
        return scored.assign(chunk=chunk, rows=rows)[["chunk", "rows", *names, "error"]]

    return segments.groupBy("chunk").applyInPandas(run, full)


def extract_response_json(df: DataFrame, response: str = "response") -> DataFrame:
    """H4: parse the JSON object inside a free-text response.

    Takes the text from the first ``{`` to the last ``}``; text that does not
    parse gives ``error``, the raw text and no anomalies.  ``parsed`` is the whole
    object as a VARIANT, so keys that the fixed columns do not know are kept, in
    the object and in each of its findings.
    """
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    text = F.when(found != "", found).otherwise(F.col(response))
    schema = f"{RESPONSE_SCHEMA}, _corrupt string"
    parsed = F.from_json(
        text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    usable = F.startswith(F.ltrim(text), F.lit("{")) & F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    return (
        df.withColumn("_p", parsed)
        .withColumn("_ok", F.coalesce(usable, F.lit(False)))
        .withColumns(
            {
                "anomalies_detected": F.when(F.col("_ok"), F.coalesce("_p.anomalies_detected", F.lit(False))).otherwise(F.lit(False)),
                "confidence": F.when(F.col("_ok"), F.col("_p.confidence").try_cast("double")),
                "explanation": F.when(F.col("_ok"), F.col("_p.explanation")),
                "findings": F.when(F.col("_ok"), F.col("_p.findings")),
                "parsed": F.when(F.col("_ok"), F.try_parse_json(text)),
                "error": F.when(F.col("_ok"), F.col("_p.error")).otherwise(F.lit(PARSE_ERROR)),
                "raw_response": F.when(~F.col("_ok"), F.col(response)),
            }
        )
        .drop("_p", "_ok")
    )


def _confident() -> Column:
    return F.col("anomalies_detected") & (F.coalesce("confidence", F.lit(0.0)) >= HIGH_CONFIDENCE)


def segment_rollup(responses: DataFrame) -> DataFrame:
    """H5: one row over the confident anomalous segments; ``segment_types`` names the types.

    ``anomaly_types`` is the number of different finding names.
    """
    confident = responses.select(
        F.coalesce(_confident(), F.lit(False)).alias("confident"),
        F.expr("transform(findings, f -> f.type) AS types"),
    )
    known = segment_types(responses).agg(F.count("*")).scalar()
    return confident.agg(
        F.expr("count_if(confident) AS anomaly_chunks"),
        F.expr("coalesce(sum(size(types)) FILTER (WHERE confident AND types IS NOT NULL), 0L) AS total_anomalies"),
        F.expr("count(*) AS total_chunks"),
    ).select("anomaly_chunks", "total_anomalies", known.alias("anomaly_types"), "total_chunks")


def segment_types(responses: DataFrame) -> DataFrame:
    """H5, long: (type, findings) of the confident anomalous segments."""
    names = responses.filter(F.coalesce(_confident(), F.lit(False))).selectExpr("explode(findings.type) AS type")
    return names.filter("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("findings"))


def segment_report(responses: DataFrame) -> DataFrame:
    """H6: one row with the segment counts of the report."""
    clean_run = F.col("error").isNull()
    return responses.agg(
        F.count("*").alias("segments_analyzed"),
        F.count_if(~clean_run).alias("error_segments"),
        F.count_if(clean_run & F.col("anomalies_detected")).alias("segments_with_anomalies"),
        F.count_if(clean_run & _confident()).alias("high_confidence_segments"),
    )


def abbreviate_rows(rows: Column) -> Column:
    """H6: row list as text; above ten rows the first five and the last five."""
    texts = F.transform(rows, lambda r: r.cast("string"))
    first, last = F.slice(texts, 1, 5), F.slice(texts, -5, 5)
    hidden = (F.size(rows) - LISTED_ROWS).cast("string")
    short = F.concat(
        F.array_join(first, ", "), F.lit(", ... ("), hidden, F.lit(" more rows) ..., "), F.array_join(last, ", ")
    )
    return F.when(F.size(rows) <= LISTED_ROWS, F.array_join(texts, ", ")).otherwise(short)


def report_findings(responses: DataFrame) -> DataFrame:
    """H6: one row per finding of a confident segment; rows whole and as short text."""
    listed = responses.filter(F.col("error").isNull() & _confident())
    entries = listed.select("chunk", "confidence", F.posexplode("findings").alias("_i", "f"))
    columns = F.array_join(F.coalesce("f.columns_involved", F.array(F.lit("Unknown"))), ", ")
    return entries.select(
        "chunk",
        "confidence",
        (F.col("_i") + 1).alias("finding"),
        F.coalesce("f.type", F.lit("Unknown")).alias("type"),
        F.coalesce("f.severity", F.lit("N/A")).alias("severity"),
        F.coalesce("f.description", F.lit("No description")).alias("description"),
        columns.alias("columns_involved"),
        F.when(F.size("f.row_indices") > 0, abbreviate_rows(F.col("f.row_indices"))).alias("rows_affected"),
        F.col("f.row_indices").alias("row_indices"),
    )
