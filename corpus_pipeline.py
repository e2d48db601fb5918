"""Corpus pipeline: toxicity, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept.
Its result is written as Parquet in the shared folder and read again as the next one's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamperlens.llm.common import Scratch, table
from tamperlens.llm.jaccard_forest import jaccard_join, one_of_each_group
from tamperlens.llm.mixing import WORD, mix_sources, take
from tamperlens.llm.packing import pack_documents
from tamperlens.llm.pii import redact
from tamperlens.llm.queries import vocabulary
from tamperlens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (7): documents scored 0.7 or more go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (6): of each group the document of the smallest id stays."""
    return one_of_each_group(docs, jaccard_join(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (2): every span found is replaced by its kind; lengths follow the new text."""
    redacted = redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.selectExpr(
        *[f"CAST(length(text) AS BIGINT) AS `{c}`" if c == "n_chars" else f"`{c}`" for c in docs.columns]
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (8): rows are left out, kept or repeated so that sources meet their targets."""
    size = f"regexp_count(coalesce(text, ''), r'{WORD}')"
    return take(mix_sources(docs, size, "array(source)"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (9): pieces of sequences of at most 2048 ids along the curve."""
    return pack_documents(docs, vocabulary(), length=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("source mix", mix),
    ("packing", pack),
]

#: learned and sequential stages have no SQL; the tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.stage(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
