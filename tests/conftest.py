from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tamperlens.plans.limits import Limits

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def tiny():
    """Limits that send even small fixtures down the fully distributed plans."""
    return Limits(
        window_rows=3,
        percentile_rows=3,
        block_rows=5,
        hot_rows=4,
        max_hot_keys=1000,
        lookup_rows=0,
        spread=3,
    )


def by(rows, *names):
    """Collected rows as a dict keyed by one or more columns."""
    if len(names) == 1:
        return {r[names[0]]: r for r in rows}
    return {tuple(r[n] for n in names): r for r in rows}


def same_rows(a, b) -> bool:
    """Equal content; doubles may differ by rounding."""

    def plain(v):
        if isinstance(v, float):
            return "NaN" if v != v else float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        if isinstance(v, dict):
            return tuple((k, plain(x)) for k, x in sorted(v.items()))
        return v

    def listing(df):
        names = sorted(df.columns)
        return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)

    return listing(a) == listing(b)
