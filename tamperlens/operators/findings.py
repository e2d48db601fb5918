"""Findings of all checks in one long table, and their summary."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.plans.staging import stage


def findings_long(results: Mapping[str, DataFrame]) -> DataFrame:
    """(type, row_index, severity, description, significance_changed, details).

    ``results`` maps a finding type to the rows of its check; ``details`` keeps
    the whole row as JSON.
    """
    parts = []
    for name, rows in results.items():

        def field(column: str, kind: str):
            found = F.col(column) if column in rows.columns else F.lit(None)
            return found.cast(kind).alias(column)

        parts.append(
            rows.select(
                F.lit(name).alias("type"),
                field("row_index", "bigint"),
                field("severity", "int"),
                field("description", "string"),
                field("significance_changed", "boolean"),
                F.to_json(F.struct(*rows.columns)).alias("details"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def findings_summary(findings: DataFrame) -> DataFrame:
    """Per type its count, with totals and the significance flag.

    The per-type counts are staged, so the totals do not repeat the checks.
    """
    flag = (
        F.col("significance_changed") if "significance_changed" in findings.columns else F.lit(None)
    )
    per_type = stage(
        findings.groupBy("type").agg(
            F.count("*").alias("finding_count"),
            F.coalesce(F.bool_or(flag.cast("boolean")), F.lit(False)).alias("significance_changed"),
        )
    )
    totals = per_type.agg(
        F.struct(F.sum("finding_count").alias("issues"), F.count("*").alias("types"))
    ).scalar()
    return per_type.select(
        "type",
        F.initcap(F.replace("type", F.lit("_"), F.lit(" "))).alias("title"),
        "finding_count",
        "significance_changed",
        totals["issues"].alias("total_issues"),
        totals["types"].alias("distinct_types"),
    )
