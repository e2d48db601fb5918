from __future__ import annotations

import pytest

from tamperlens.llm.common import table


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 5, 1.0, "x"),
        (1, "one two three four five six seven eight", "en", "a", 5, 1.0, "x"),
        (2, "one two three four five six seven eight", None, None, None, None, None),
        (3, None, "en", "b", None, 2.0, "y"),
        (4, "", "en", "b", 0, 2.0, "y"),
        (5, "   \n\t ", "en", None, 0, 2.0, "y"),
        (None, "no id here but words enough to count", "en", "a", 5, 2.0, None),
        (6, "short", "en", "a", 5, 3.0, "z"),
        (7, "word " * 60_000, "en", "b", 5, 3.0, "z"),
        (8, "x" * 120_000, "en", "b", 5, 3.0, "z"),
        (9, "1." * 20_000 + "+" * 10_000 + "a@" * 10_000 + '"' * 1000, "en", "b", 5, 3.0, "z"),
    ]
    # names that the operators use for columns of their own
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars int, score double, _key string"
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
