"""Every registered query against its SQL on the test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tools.check_queries import compare


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    good, note = compare(spark, sf_dir, name)
    assert good, note


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 8


def test_sql_only_for_known_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
