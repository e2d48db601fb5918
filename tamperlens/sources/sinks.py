"""Writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A10: findings as JSON lines with native types; NULL fields are kept.

    Maps, arrays and structs stay nested and booleans are JSON booleans.
    """
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
