"""Joins from facts to per-key results that stay even when a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.staging import Sizes


def attach_by_key(
    facts: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    rows: str,
    limits: Limits = DEFAULT_LIMITS,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Inner join of facts to a staged one-row-per-key table whose ``rows`` counts facts.

    ``sizes`` are those that :func:`tamperlens.plans.staging.stage_keys` gave, of this table
    or of one it was filtered from; without them a job asks for them.

    At most ``max_hot_keys`` keys can own more than 1/max_hot_keys of all rows,
    so those go out as a broadcast of proven size and their fact rows stay where
    they are; only the rows of the other keys meet their results in a shuffle.
    Without a hot key this is an ordinary equi-join, and Catalyst broadcasts the
    staged table whenever its known file size allows.
    """
    total, largest = sizes or per_key.agg(F.sum(rows), F.max(rows)).first()
    floor = max(limits.hot_rows, int(total or 0) // limits.max_hot_keys + 1)
    if (largest or 0) < floor:
        return facts.join(per_key, list(keys))
    payload = [c for c in per_key.columns if c not in keys]
    names = [quoted(k) for k in keys]
    hot = per_key.filter(f"{quoted(rows)} >= {floor}")
    cold = per_key.filter(f"{quoted(rows)} < {floor}")
    # rows without a key match nothing and must not pile up in the shuffle
    keyed = facts.filter(" AND ".join(f"{k} IS NOT NULL" for k in names))
    columns = [quoted(c) for c in [*facts.columns, *payload]]
    here = keyed.join(F.broadcast(hot), list(keys)).selectExpr(*columns)
    rest = keyed.join(F.broadcast(hot.selectExpr(*names)), list(keys), "left_anti")
    return here.unionAll(rest.join(cold, list(keys)).selectExpr(*columns))


def join_spread(
    facts: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    spread: int,
) -> DataFrame:
    """Inner join where ``few`` has few rows per key but facts may pile up on a key."""
    salted = facts.withColumn("_salt", F.expr(f"pmod(xxhash64({quoted(spread_by)}), {spread}L)"))
    copies = few.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {spread - 1}L)")))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
