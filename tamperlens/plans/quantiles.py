"""Exact quantiles per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.staging import stage_keys, stage_observed

#: two to the bits of a double's mantissa, and the least double with a leading one
MANTISSA, LEAST_ORDINARY = 1 << 52, 2.0**-1022


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    largest: int,
    limits: Limits = DEFAULT_LIMITS,
    weight: str | None = None,
) -> DataFrame:
    """One row per key, one interpolated quantile column per entry.

    ``largest`` is the row count of the biggest key, known from the caller's
    statistics.  While every group fits one buffer the built-in percentile is used;
    beyond that the ranks are selected digit by digit (:func:`selected_quantiles`),
    which neither sorts nor shuffles values.  Both give equal bits.  With a BIGINT column
    ``weight`` a row stands for so many equal values.
    """
    present = df.filter(f"{quoted(value)} IS NOT NULL")
    if largest <= limits.percentile_rows:
        ranks = ", ".join(f"{p}D" for p in probabilities.values())
        times = f", {quoted(weight)}" if weight else ""
        found = present.groupBy(*keys).agg(
            F.expr(f"percentile({quoted(value)}, array({ranks}){times}) AS _q")
        )
        return found.selectExpr(
            *[quoted(k) for k in keys],
            *[f"_q[{i}] AS {quoted(name)}" for i, name in enumerate(probabilities)],
        )
    return selected_quantiles(present, keys, value, probabilities, limits, weight)


def ordered_key(value: str) -> str:
    """A BIGINT that orders doubles as their values do: their bits, negated below zero.

    Exponent and mantissa are found by exact arithmetic: a logarithm that rounds to the
    wrong side of a power of two is put right by the mantissa it leads to.
    """
    v = f"abs(CAST({value} AS DOUBLE))"
    guess = f"CAST(floor(log2({v})) AS INT)"
    power = f"if({v} / pow(2D, {guess}) >= 2, {guess} + 1, if({v} / pow(2D, {guess}) < 1, {guess} - 1, {guess}))"
    ordinary = f"({power} + 1023) * {MANTISSA}L + CAST(({v} / pow(2D, {power}) - 1) * {MANTISSA}D AS BIGINT)"
    small = f"CAST({v} * pow(2D, 537) * pow(2D, 537) AS BIGINT)"  # multiples of the least double
    bits = (
        f"CASE WHEN {v} = double('infinity') THEN 2047L * {MANTISSA}L "
        f"WHEN {v} < {LEAST_ORDINARY!r}D THEN {small} ELSE {ordinary} END"
    )
    return f"if(CAST({value} AS DOUBLE) < 0, -1L, 1L) * {bits}"


def value_of_key(key: str) -> str:
    """The double whose :func:`ordered_key` is ``key``."""
    exponent, rest = f"(abs({key}) div {MANTISSA}L)", f"(abs({key}) % {MANTISSA}L)"
    bits = (
        f"CASE WHEN {exponent} = 2047 THEN double('infinity') "
        f"WHEN {exponent} = 0 THEN {rest} * pow(2D, -537) * pow(2D, -537) "
        f"ELSE (1 + {rest} / {MANTISSA}D) * pow(2D, {exponent} - 1023) END"
    )
    return f"if({key} < 0, -1D, 1D) * {bits}"


def selected_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    limits: Limits = DEFAULT_LIMITS,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles of groups of any size by radix selection, for all keys at once.

    A round counts, among the values that share the digits found so far for a rank, how
    many have which next 16 bits; the running count tells the rank's bucket. A task shuffles
    at most one count for each bucket of a rank, whatever its values. After four rounds,
    or as soon as every bucket in question holds one value, all ranks are known.
    """
    names = [quoted(k) for k in keys]
    times = quoted(weight) if weight else "1L"
    cells = df.selectExpr(*names, f"{ordered_key(quoted(value))} AS _k", f"{times} AS _times")
    per_key, sizes = stage_keys(cells.groupBy(*keys).agg(F.sum("_times").alias("_n")), "_n")
    ends = [f"CAST({side}({p}D * (_n - 1)) AS BIGINT)" for p in probabilities.values() for side in ("floor", "ceil")]
    open_ranks = per_key.selectExpr(
        *names, "_n", f"explode(array_distinct(array({', '.join(ends)}))) AS _rank"
    ).selectExpr(*names, "_n", "_rank", "_rank AS _rest", "0L AS _digits")
    found = None
    for shift in (48, 32, 16, 0):
        asked = open_ranks.groupBy(*keys, "_n").agg(F.collect_set("_digits").alias("_asked"))
        prefix = f"shiftright(_k, {shift + 16})" if shift < 48 else "0L"
        counts = (
            attach_by_key(cells, asked, keys, "_n", limits, sizes)
            .selectExpr(*names, "_k", "_times", "_asked", f"{prefix} AS _digits")
            .where("array_contains(_asked, _digits)")
            .groupBy(*keys, "_digits", F.expr(f"shiftright(_k, {shift})").alias("_next"))
            .agg(F.sum("_times").alias("_c"), F.min("_k").alias("_low"), F.max("_k").alias("_high"))
        )
        upto = f"sum(_c) OVER (PARTITION BY {', '.join([*names, '_digits'])} ORDER BY _next)"
        running = counts.selectExpr("*", f"{upto} AS _upto")
        placed = open_ranks.join(running, [*keys, "_digits"]).where("_rest < _upto AND _rest >= _upto - _c")
        step, seen = stage_observed(
            placed.selectExpr(*names, "_n", "_rank", "_rest - (_upto - _c) AS _rest", "_next AS _digits", "_low", "_high"),
            open="count_if(_low <> _high)",
        )
        known = step.where("_low = _high").selectExpr(*names, "_n", "_rank", f"{value_of_key('_low')} AS _v")
        found = known if found is None else found.unionAll(known)
        if not seen["open"]:
            break
        open_ranks = step.where("_low <> _high").drop("_low", "_high")
    aggregates, columns = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        rank = f"({p}D * (_n - 1))"
        aggregates += [
            F.expr(f"max(if(_rank = {side}({rank}), _v, NULL)) AS {end}{i}") for side, end in (("floor", "_lo"), ("ceil", "_hi"))
        ]
        columns.append(f"{_between(rank, f'_lo{i}', f'_hi{i}')} AS {quoted(name)}")
    return found.groupBy(*keys, "_n").agg(*aggregates).selectExpr(*names, *columns)


def _between(rank: str, low: str, high: str) -> str:
    """The formula of the built-in percentile, so that all plans give equal bits."""
    return f"if({low} = {high}, {low}, (ceil({rank}) - {rank}) * {low} + ({rank} - floor({rank})) * {high})"


def quantile_columns(
    value: str, probabilities: Mapping[str, float], total: str = "_n", upto: str = "_upto"
) -> tuple[list, list[str]]:
    """Aggregates over rows with running counts, and SQL of the quantiles over their result.

    The result needs ``_n``, the number of values.
    """
    aggregates, columns = [], []
    for name, p in probabilities.items():
        low, high = quoted(f"_lo_{name}"), quoted(f"_hi_{name}")
        for end, side in ((low, "floor"), (high, "ceil")):
            aggregates.append(
                F.expr(f"min(if({upto} > {side}({p}D * ({total} - 1)), {quoted(value)}, NULL)) AS {end}")
            )
        columns.append(f"{_between(f'({p}D * (_n - 1))', low, high)} AS {quoted(name)}")
    return aggregates, columns
