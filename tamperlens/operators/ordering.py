"""Ordering forensics: repeated and misplaced identifiers.

All operators expect a dense ``row_id`` (see ``with_row_id``) as the file order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import (
    clean_sql,
    group_label,
    group_map,
    is_numeric,
    long_form,
    numeric_columns,
    present_columns,
    quoted,
    require_columns,
)
from tamperlens.operators.rows import flag_rows
from tamperlens.plans.blocks import (
    fits_window,
    over_neighbours,
    position_in_group,
    previous_row_value,
)
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import DEFAULT_LIMITS, Limits
from tamperlens.plans.staging import (
    BLOCK,
    SEQ,
    Sizes,
    partition_by,
    running_total,
    stage,
    stage_keys,
    stage_observed,
    stage_sorted,
)

# fixed values: thresholds of the ordering checks
NUMERIC_SHIFT = 4
STRING_SHIFT = 2
STRING_SEVERITY = 7
TOP_SEVERITY = 9
CLUSTER_SIZE = 5
LONE_SHIFT = 7
NOTED_EFFECT = 0.5
LARGE_EFFECT = 0.8
NEIGHBOURS = 2
# so many times what a lookup may broadcast still goes by an ordinary join
MANY_LOOKUPS = 20


def _identified(
    df: DataFrame, id_col: str, row_id: str, groups: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """(row_index, _id, _g0, …) and the names of the group columns in it."""
    require_columns(df, [id_col, row_id, *groups])
    keys = [f"_g{i}" for i in range(len(groups))]
    grouped = [f"{clean_sql(df, g)} AS {k}" for g, k in zip(groups, keys)]
    facts = df.selectExpr(
        f"{quoted(row_id)} AS row_index", f"{clean_sql(df, id_col)} AS _id", *grouped
    )
    return facts, keys


def _as_columns(groups: str | Sequence[str]) -> list[str]:
    return [groups] if isinstance(groups, str) else list(groups)


# --- repeated identifiers -------------------------------------------------


def _with_id_counts(
    df: DataFrame, id_col: str, row_id: str, limits: Limits
) -> tuple[DataFrame, DataFrame]:
    """(_id, count) of repeated ids, and their rows with the count."""
    facts, _ = _identified(df, id_col, row_id)
    known = facts.filter("_id IS NOT NULL")
    counts, sizes = stage_keys(
        known.groupBy("_id").agg(F.expr("count(*) AS count")).filter("count > 1"), "count"
    )
    return counts, attach_by_key(known, counts, ["_id"], "count", limits, sizes)


def duplicate_id_rows(
    df: DataFrame, id_col: str, row_id: str = "row_id", limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """C1, long: (id_value, row_index, count) for every row of every repeated id."""
    _, rows = _with_id_counts(df, id_col, row_id, limits)
    return rows.selectExpr("cast(_id AS STRING) AS id_value", "row_index", "count")


def duplicate_ids(
    df: DataFrame,
    id_col: str,
    row_id: str = "row_id",
    per_part: int = 1000,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The positions of every repeated id, in parts of at most ``per_part`` rows.

    An id of up to ``per_part`` rows is one row with part 0.  The rows of a larger
    id are listed by blocks of the file, ``part`` being the block, so its lists
    are complete and none grows with the id.  NULL ids are not duplicates.
    """
    _, rows = _with_id_counts(df, id_col, row_id, limits)
    listed = (
        rows.withColumn("part", F.expr(f"if(count <= {per_part}, 0L, row_index div {per_part})"))
        .groupBy("_id", "part")
        .agg(F.expr("max(count) AS count"), F.expr("sort_array(collect_list(row_index)) AS rows"))
    )
    return listed.selectExpr(
        "'duplicate_id' AS type",
        "cast(_id AS STRING) AS id_value",
        "count",
        "part",
        "rows",
        f"{TOP_SEVERITY} AS severity",
        "concat(_id, ' stands in ', count, ' rows') AS description",
    )


def _as_previous(df: DataFrame, id_col: str, value: str) -> str:
    """SQL of an id as ``previous_id``."""
    numeric = is_numeric(df.schema[id_col].dataType)
    return f"cast(cast({value} AS BIGINT) AS STRING)" if numeric else f"cast({value} AS STRING)"


def _with_previous_id(
    findings: DataFrame, df: DataFrame, id_col: str, row_id: str, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Id of the row before, over the whole file; NULL for the first row.

    Few findings look their row numbers up in one pass over the table; many meet
    it in an equi-join on the row number, where no key repeats.
    """
    text = f"{_as_previous(df, id_col, '_id')} AS _id"
    identified, _ = _identified(df, id_col, row_id)
    before = previous_row_value(
        identified.selectExpr("row_index", text), "row_index", "_id", "previous_id"
    )
    if limits.lookup_rows > 0:
        findings, seen = stage_observed(findings, n="count(*)")
        if seen["n"] <= limits.lookup_rows:
            asked = findings.select("row_index").distinct()
            before = before.join(F.broadcast(asked), "row_index")
    return findings.join(before, "row_index", "left")


def previous_ids(df: DataFrame, id_col: str, row_id: str = "row_id") -> DataFrame:
    """(row_index, id_value, previous_id) for every row."""
    facts, _ = _identified(df, id_col, row_id)
    rows = facts.selectExpr("row_index", "cast(_id AS STRING) AS id_value")
    # every row asks, so there is no short list to look up
    return _with_previous_id(rows, df, id_col, row_id, Limits(lookup_rows=0))


def _repeated_across_groups(facts: DataFrame, keys: list[str], limits: Limits) -> DataFrame:
    """The rows of ``facts`` with ``duplicate_count`` and ``different_conditions``, without texts."""
    facts = facts.filter("_id IS NOT NULL")
    per_pair = facts.groupBy("_id", *keys).agg(F.expr("count(*) AS n"))
    per_id, sizes = stage_keys(
        per_pair.groupBy("_id")
        .agg(F.expr("sum(n) AS duplicate_count"), F.expr("count(*) AS different_conditions"))
        .filter("duplicate_count > 1 AND different_conditions > 1"),
        "duplicate_count",
    )
    return attach_by_key(facts, per_id, ["_id"], "duplicate_count", limits, sizes).withColumns(
        {"type": F.expr("'duplicate_id'"), "severity": F.expr(str(TOP_SEVERITY))}
    )


def _repeated_texts(groups: list[str], keys: list[str]) -> dict[str, Column]:
    """The texts of a row of ``_repeated_across_groups``, made where it is shown."""
    return {
        "id_value": F.expr("cast(_id AS STRING)"),
        "condition_values": group_map(groups, keys),
        "group_label": group_label(groups, keys),
        "description": F.expr("concat(_id, ' stands in ', different_conditions, ' groups')"),
    }


REPEATED = [
    "type", "id_value", "row_index", "condition_values", "group_label",
    "duplicate_count", "different_conditions", "severity", "description",
]


def duplicate_ids_across_groups(
    df: DataFrame,
    id_col: str,
    groups: str | Sequence[str],
    row_id: str = "row_id",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Every row of an id that occurs in more than one group.

    The other rows of an id are those with its ``id_value``, here and in
    ``duplicate_ids``; a list of them in each row would grow with the square of
    the id's rows.  A NULL group is one group value.
    """
    groups = present_columns(df, _as_columns(groups))
    facts, keys = _identified(df, id_col, row_id, groups)
    found = _repeated_across_groups(facts, keys, limits).withColumns(_repeated_texts(groups, keys))
    return _with_previous_id(found.select(*REPEATED), df, id_col, row_id, limits)


# --- misplaced identifiers ------------------------------------------------


def _id_counts(facts: DataFrame, keys: list[str], *spans: str) -> DataFrame:
    """(keys…, _id, _n, spans…): rows of each id in its group."""
    return facts.filter("_id IS NOT NULL").groupBy(*keys, "_id").agg(
        F.expr("count(*) AS _n"), *[F.expr(sql) for sql in spans]
    )


def _id_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``_id_counts`` with ``_upto``, the rows of all ids up to it in its group."""
    return running_total(stage_sorted(counts, [*keys, "_id"]), keys, "_n", "_upto").drop(SEQ, BLOCK)


def _expected_by_rank(
    placed: DataFrame, facts: DataFrame, keys: list[str], small: bool, limits: Limits
) -> DataFrame:
    """Add ``expected_position``: the last sorted position of the row's id.

    Takes rows with an id; ``facts`` are the rows before any window ran, so the
    ranks of the distributed plan do not repeat the position windows.
    """
    if small:
        upto = f"count(_id) OVER ({partition_by(keys)} ORDER BY _id RANGE UNBOUNDED PRECEDING)"
        return placed.withColumn("expected_position", F.expr(f"{upto} - 1"))
    ranked, sizes = stage_keys(_id_ranks(_id_counts(facts, keys), keys), "_n")
    joined = attach_by_key(placed, ranked, [*keys, "_id"], "_n", limits, sizes)
    return joined.withColumn("expected_position", F.expr("_upto - 1")).drop("_n", "_upto")


def _descents(window: str) -> dict[str, str]:
    """Whether the id sorts before the one preceding it in its block, or is missing."""
    return {"_descent": f"coalesce(_id < lag(_id) OVER ({window}), false) OR _id IS NULL"}


def _in_blocks(facts: DataFrame, keys: list[str], limits: Limits) -> DataFrame:
    """Staged positions by block windows, with ``_descent``."""
    return stage(
        position_in_group(facts, keys, "row_index", "actual_position", limits.block_rows, _descents)
    )


def _along_file(facts: DataFrame, keys: list[str], limits: Limits) -> DataFrame:
    """``_in_blocks`` of the rows of all groups, with the ``_previous`` id of the file; not staged.

    One shuffle by block of the file serves all; the first row of a block takes the last id of
    the block before, one row for each block.
    """
    size = max(limits.block_rows, 1)
    ends = facts.filter(f"pmod(row_index, {size}L) = {size - 1}L")
    ends = previous_row_value(ends.select("row_index", "_id"), "row_index", "_id", "_carried")

    def before(window: str) -> dict[str, str]:
        follows = f"lag(row_index) OVER ({window}) = row_index - 1"
        return {"_near": f"if({follows}, lag(_id) OVER ({window}), NULL)"}

    placed = position_in_group(facts, keys, "row_index", "actual_position", size, _descents, before)
    return (
        placed.join(F.broadcast(ends), "row_index", "left")
        .withColumn("_previous", F.expr("coalesce(_near, _carried)"))
        .drop("_near", "_carried")
    )


def _by_order(placed: DataFrame, keys: list[str], limits: Limits) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups whose ids never descend, and of the others; None where there are none.

    Ids are compared inside blocks by ``_descent`` and at block ends by one row for each group
    and block. A group with a missing id is one of the others.
    """
    blocks = placed.groupBy(*keys, F.expr(f"row_index div {limits.block_rows}L AS _ob")).agg(
        F.expr("count(*) AS _in"),
        F.expr("max(_descent) AS _inside"),
        F.expr("min_by(_id, row_index) AS _head"),
        F.expr("max_by(_id, row_index) AS _tail"),
    )
    before = f"lag(_tail) OVER ({partition_by(keys)} ORDER BY _ob)"
    states = (
        blocks.selectExpr(*keys, "_in", f"_inside OR coalesce(_head < {before}, false) AS _down")
        .groupBy(*keys)
        .agg(F.expr("max(_down) AS _disordered"), F.expr("sum(_in) AS _rows"))
    )
    states, seen = stage_observed(
        states, total="sum(_rows)", largest="max(_rows)", down="count_if(_disordered)", n="count(*)"
    )
    if seen["down"] == 0:
        return placed, None
    if seen["down"] == seen["n"]:
        return None, placed
    sizes = Sizes(seen["total"], seen["largest"])
    marked = attach_by_key(placed, states, keys, "_rows", limits, sizes).drop("_rows")
    return tuple(marked.filter(test).drop("_disordered") for test in ("NOT _disordered", "_disordered"))


def _moved_rows(placed: DataFrame, keys: list[str], shift: int, limits: Limits) -> DataFrame:
    """Rows of ``_in_blocks`` that stand ``shift`` places and more off, with neighbours.

    The first and last position of an id in its group tell whether any of its rows is off,
    so only the rows of such ids meet their rank, and only rows near them are looked up.
    Where ids never descend, the last position of an id is its rank and nothing is sorted.
    Many rows off their place take the block windows over all rows.
    """
    spans = ["min(actual_position) AS _first", "max(actual_position) AS _last"]
    off = f"greatest(abs(_first - _upto + 1), abs(_last - _upto + 1)) >= {shift}"
    rising, others = _by_order(placed, keys, limits)
    placed = placed.drop("_descent")
    ranks = []
    if rising is not None:
        ranks.append(_id_counts(rising, keys, *spans).withColumn("_upto", F.expr("_last + 1")))
    if others is not None:
        ranks.append(_id_ranks(_id_counts(others, keys, *spans), keys))
    moved, sizes = stage_keys(
        reduce(DataFrame.unionByName, [r.filter(off).drop("_first", "_last") for r in ranks]), "_n"
    )
    asking = (2 * NEIGHBOURS + 1) * sizes.total
    few = asking <= MANY_LOOKUPS * limits.lookup_rows
    rows = placed
    if not few:
        rows = over_neighbours(
            placed, keys, "actual_position", NEIGHBOURS, _around, limits.block_rows
        ).withColumn("surrounding_ids", F.expr(_surrounding()))
        rows = rows.select(*placed.columns, "surrounding_ids")
    found = (
        attach_by_key(rows.filter("_id IS NOT NULL"), moved, [*keys, "_id"], "_n", limits, sizes)
        .withColumn("expected_position", F.expr("_upto - 1"))
        .drop("_n", "_upto")
        .filter(f"abs(actual_position - expected_position) >= {shift}")
    )
    if not few:
        return found
    found = stage(found)
    asked = found.selectExpr(
        *keys,
        "row_index AS _asking",
        f"explode(sequence({-NEIGHBOURS}, {NEIGHBOURS})) AS relative_position",
        "actual_position + relative_position AS actual_position",
    )
    near = (
        placed.select(*keys, "actual_position", "_id")
        .join(F.broadcast(asked) if asking <= limits.lookup_rows else asked, [*keys, "actual_position"])
        .groupBy(F.col("_asking").alias("row_index"))
        .agg(
            F.expr(
                "sort_array(collect_list(struct(relative_position, cast(_id AS STRING) AS id_value))) "
                "AS surrounding_ids"
            )
        )
    )
    return found.join(near, "row_index")


def _only_disordered(rows: DataFrame, keys: list[str], small: bool, limits: Limits) -> DataFrame:
    """Keep groups in which some id sorts before the id preceding it."""
    if small:
        marked = rows.selectExpr("*", f"max(_descent) OVER ({partition_by(keys)}) AS _disordered")
        return marked.filter("_disordered").drop("_disordered")
    states, sizes = stage_keys(
        rows.groupBy(*keys).agg(F.expr("max(_descent) AS _disordered"), F.expr("count(*) AS _rows")), "_rows"
    )
    marked = attach_by_key(rows, states, keys, "_rows", limits, sizes)
    return marked.filter("_disordered").drop("_disordered", "_rows")


def _around(window: str) -> dict[str, str]:
    """The neighbouring ids as structs, NULL only where there is no row."""
    steps = range(1, NEIGHBOURS + 1)
    before = {f"_before{k}": f"lag(struct(_id), {k}) OVER ({window})" for k in steps}
    after = {f"_after{k}": f"lead(struct(_id), {k}) OVER ({window})" for k in steps}
    return {**before, **after}


def _surrounding() -> str:
    """SQL of ARRAY<STRUCT<relative_position, id_value>> around the row."""
    steps = range(1, NEIGHBOURS + 1)
    places = [(-k, f"_before{k}") for k in reversed(steps)] + [(k, f"_after{k}") for k in steps]
    entries = [
        f"if({c} IS NULL, NULL, struct({k} AS relative_position, cast({c}._id AS STRING) AS id_value))"
        for k, c in places
    ]
    entries.insert(NEIGHBOURS, "struct(0 AS relative_position, cast(_id AS STRING) AS id_value)")
    return f"array_compact(array({', '.join(entries)}))"


def _misplaced(
    facts: DataFrame, keys: list[str], groups: list[str], numeric: bool, small: bool, limits: Limits
) -> DataFrame:
    """C3-C5; ``previous_id`` (inside the group) only for ids that are no numbers.

    ``facts`` has (row_index, _id, keys…), where all keys are known. They may come from
    ``_along_file``, staged; their ``_previous`` stays.
    """
    kept = [F.col(c) for c in facts.columns if c == "_previous"]
    shift = NUMERIC_SHIFT if numeric else STRING_SHIFT
    if numeric and not small:
        placed = facts if "_descent" in facts.columns else _in_blocks(facts, keys, limits)
        ranked = _moved_rows(placed, keys, shift, limits)
    else:
        facts = facts.drop("actual_position", "_descent")
        block_rows = None if small else limits.block_rows
        placed = position_in_group(facts, keys, "row_index", "actual_position", block_rows)
        seen = over_neighbours(placed, keys, "actual_position", NEIGHBOURS, _around, block_rows)
        if not numeric:
            descent = (
                "_before1 IS NOT NULL AND _id IS NOT NULL AND (_before1._id IS NULL OR _id < _before1._id)"
            )
            seen = _only_disordered(seen.selectExpr("*", f"{descent} AS _descent"), keys, small, limits)
        ranked = _expected_by_rank(seen.filter("_id IS NOT NULL"), facts, keys, small, limits)
        ranked = ranked.withColumn("surrounding_ids", F.expr(_surrounding()))
    flagged = ranked.selectExpr(
        "*", "abs(actual_position - expected_position) AS position_difference"
    ).filter(f"position_difference >= {shift}")
    if numeric:
        severity = f"cast(least(position_difference + 5, {TOP_SEVERITY}) AS INT)"
        description = "concat(_id, ' stands ', position_difference, ' places off its sorted place')"
        previous = []
    else:
        severity = str(STRING_SEVERITY)
        description = "concat(_id, ' stands off its sorted place')"
        previous = [F.expr("cast(_before1._id AS STRING) AS previous_id")]
    return flagged.select(
        F.expr("'out_of_sequence_id' AS type"),
        F.expr("cast(_id AS STRING) AS id_value"),
        "row_index",
        group_map(groups, keys).alias("condition_values"),
        group_label(groups, keys).alias("group_label"),
        "actual_position",
        "expected_position",
        "position_difference",
        "surrounding_ids",
        F.expr(f"{severity} AS severity"),
        F.expr(f"{description} AS description"),
        *previous,
        *kept,
    )


def out_of_sequence_ids(
    df: DataFrame,
    id_col: str,
    groups: str | Sequence[str],
    row_id: str = "row_id",
    strategy: str = "auto",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Ids that stand away from their sorted place inside the group.

    Numeric ids are flagged from four places on, other ids from two places on
    and only in groups that are not sorted.  ``strategy`` picks plain group
    windows or block windows; ``auto`` measures the largest group first.
    """
    groups = present_columns(df, _as_columns(groups))
    require_columns(df, [id_col, row_id])
    facts, keys = _identified(df, id_col, row_id, groups)
    facts = facts.dropna(subset=keys)
    small = fits_window(facts, keys, limits, strategy)
    numeric = is_numeric(df.schema[id_col].dataType)
    found = _misplaced(facts, keys, groups, numeric, small, limits)
    if "previous_id" in found.columns:
        return found
    return _with_previous_id(found, df, id_col, row_id, limits)


def filter_order_anomalies(findings: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Keep clusters of five and more whole, from smaller ones the far shifts.

    Takes ``out_of_sequence_ids`` rows; duplicates are always kept and need not
    pass through here.
    """
    staged = stage(findings.withColumn("_key", F.to_json("condition_values")))
    per_key, sizes = stage_keys(staged.groupBy("_key").agg(F.count("*").alias("_size")), "_size")
    sized = attach_by_key(staged, per_key, ["_key"], "_size", limits, sizes)
    clustered = f"_size >= {CLUSTER_SIZE}"
    note = "concat(description, ', one of ', _size, ' in ', group_label)"
    return (
        sized.filter(f"{clustered} OR position_difference >= {LONE_SHIFT}")
        .withColumns(
            {
                "cluster_size": F.expr(f"if({clustered}, _size, NULL)"),
                "severity": F.expr(f"if({clustered}, least(severity + 1, {TOP_SEVERITY}), severity)"),
                "description": F.expr(f"if({clustered}, {note}, description)"),
            }
        )
        .drop("_key", "_size")
    )


# --- effects on measured columns ------------------------------------------


def dependent_var_effects(
    df: DataFrame,
    rows: DataFrame | Iterable[int],
    columns: Sequence[str] | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """Columns whose mean among the listed rows is half a deviation off or more."""
    columns = numeric_columns(df, columns, exclude=[row_id])
    narrow = df.selectExpr(*[quoted(c) for c in [row_id, *columns]])
    flagged = flag_rows(narrow, rows, row_id, "_anomalous")
    sides = {"anomalous": "_anomalous", "non_anomalous": "NOT _anomalous"}
    aggregates = [
        F.expr(f"{fn}(value) FILTER (WHERE {test}) AS {side}_{name}")
        for side, test in sides.items()
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("n", "count"))
    ]
    stats = long_form(flagged, columns, ["_anomalous"]).groupBy("column").agg(*aggregates)
    effect = (
        "if(non_anomalous_std > 0, (anomalous_mean - non_anomalous_mean) / non_anomalous_std, 0D)"
    )
    return (
        stats.filter("anomalous_n >= 2 AND non_anomalous_n >= 2")
        .selectExpr("*", f"{effect} AS effect_size")
        .filter(f"abs(effect_size) >= {NOTED_EFFECT}")
        .selectExpr(
            "`column`",
            "effect_size",
            "if(effect_size > 0, 'higher', 'lower') AS direction",
            "anomalous_mean",
            "non_anomalous_mean",
            "anomalous_std",
            "non_anomalous_std",
        )
    )


def escalate_severity(
    findings: DataFrame, effects: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Attach all effects to each finding; each large one adds a severity step.

    The effects are one row per column, so they travel as one scalar subquery.
    """
    place = (
        F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
        if columns
        else F.lit(0)
    )
    fields = [c for c in effects.columns]
    listing = F.sort_array(F.collect_list(F.struct(place.alias("_p"), F.struct(*fields).alias("e"))))
    packed = effects.agg(
        F.struct(
            F.count_if(F.abs("effect_size") >= LARGE_EFFECT).alias("steps"),
            F.transform(listing, lambda x: x["e"]).alias("entries"),
        )
    ).scalar()
    steps = F.col("_effects.steps")
    return (
        findings.withColumn("_effects", packed)
        .withColumn("severity", F.least(F.lit(TOP_SEVERITY), F.col("severity") + steps).cast("int"))
        .withColumn("dependent_var_effects", F.col("_effects.entries"))
        .drop("_effects")
    )


def sorting_anomalies(
    df: DataFrame,
    id_col: str,
    groups: str | Sequence[str],
    check_dependent: bool = True,
    prioritize: Sequence[str] = (),
    row_id: str = "row_id",
    strategy: str = "auto",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Duplicates across groups and misplaced ids, filtered and ranked.

    Ids, groups, positions and previous ids are staged once; the rows are counted on that
    write, so groups are only measured where the table itself exceeds what a window may hold.
    Findings are kept without their texts until they are sorted.
    """
    groups = present_columns(df, _as_columns(groups))
    require_columns(df, [id_col, row_id])
    columns = numeric_columns(df, exclude=[id_col, row_id, *groups], prioritize=prioritize)
    numeric = is_numeric(df.schema[id_col].dataType)
    facts, keys = _identified(df, id_col, row_id, groups)
    facts, seen = stage_observed(_along_file(facts, keys, limits), n="count(*)")
    grouped = facts.dropna(subset=keys)
    small = fits_window(grouped, keys, limits, strategy, seen["n"])
    repeated = _repeated_across_groups(facts.drop("actual_position", "_descent"), keys, limits)
    misplaced = _misplaced(
        grouped if numeric else grouped.drop("_previous"), keys, groups, numeric, small, limits
    )
    kept = filter_order_anomalies(misplaced, limits)
    previous = F.expr(_as_previous(df, id_col, "_previous"))
    if numeric:
        found = repeated.unionByName(kept, allowMissingColumns=True)
    else:
        repeated = repeated.withColumn("previous_id", previous)
        found = repeated.drop("_previous").unionByName(kept, allowMissingColumns=True)
    effects = []
    if check_dependent and columns:
        found = stage(found)  # read for the effects and for the result
        found = escalate_severity(found, dependent_var_effects(df, found, columns, row_id), columns)
        effects = ["dependent_var_effects"]
    ranked = found.orderBy(F.desc("severity"), "row_index", "type")
    texts = {name: F.coalesce(name, text) for name, text in _repeated_texts(groups, keys).items()}
    if numeric:
        texts["previous_id"] = previous
    shown = ["row_index", *[c for c in REPEATED if c != "row_index"]]
    more = ["actual_position", "expected_position", "position_difference", "surrounding_ids", "cluster_size"]
    ends = [*more, "previous_id"] if numeric else ["previous_id", *more]
    return ranked.withColumns(texts).select(*shown, *ends, *effects)
