"""Registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from catalog import (
    calcchain_queries,
    distribution_queries,
    effect_queries,
    evidence_queries,
    ordering_queries,
    profile_queries,
    row_queries,
    segment_queries,
    source_queries,
)

# the scorer and workbook builder of two queries travel inside the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILIES = (
    row_queries,
    ordering_queries,
    distribution_queries,
    effect_queries,
    calcchain_queries,
    profile_queries,
    segment_queries,
    evidence_queries,
    source_queries,
)


def all_queries() -> dict:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
