"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern, the set of sources they belong to. A flow
routes token capacity from patterns to source quotas; repeating a pattern's documents costs
more with every round, so text is repeated only where a quota cannot be met without. Each
pattern then takes whole rounds of all its documents, and for the rest documents in the
order of a seeded hash: the range of hashes is narrowed until it holds few documents, and
those are filled in one by one. No running sum crosses a table.

The driver sees one row for each pattern, the named sources of the mix. Null sources are a
source of their own, null texts and texts without words have size 0 and are never taken,
equal rows are interchangeable, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch, free_name

WORD = r"[^\x20\x09-\x0D]+"
HASHES = 1 << 62
FEW = 2048
BUCKETS = 1024


def water_fill(sizes: Sequence[float], weights: Sequence[float], most: float) -> list[float]:
    """Share the sum of ``sizes`` by weight, none above ``most`` times its size.

    What is cut off is shared again by weight among the others, until none is above.
    """
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        shares = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / shares > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / shares
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            open_.discard(i)
    return targets


def route(
    capacity: Sequence[float], members: Sequence[Sequence[int]], quotas: Sequence[float], rounds: int
) -> list[dict[int, float]]:
    """Min-cost flow from patterns to quotas by successive shortest paths.

    A pattern's r-th round of ``capacity`` costs r squared a token, a convex price.
    Returns the tokens each pattern gives to each source.
    """
    patterns, sources = len(capacity), len(quotas)
    begin, end = patterns + sources, patterns + sources + 1
    heads: list[list[int]] = [[] for _ in range(end + 1)]
    arcs: list[list] = []  # [to, room, cost, reverse]

    def arc(a: int, b: int, room: float, cost: float) -> int:
        heads[a].append(len(arcs))
        arcs.append([b, room, cost, len(arcs) + 1])
        heads[b].append(len(arcs))
        arcs.append([a, 0.0, -cost, len(arcs) - 1])
        return len(arcs) - 2

    for p, size in enumerate(capacity):
        for r in range(rounds):
            arc(begin, p, float(size), float(r * r))
    given = [{s: arc(p, patterns + s, math.inf, 0.0) for s in members[p]} for p in range(patterns)]
    for s, quota in enumerate(quotas):
        arc(patterns + s, end, float(quota), 0.0)
    least = 1e-9 * max(1.0, sum(quotas))
    while True:
        cost, via, queue, queued = [math.inf] * (end + 1), [-1] * (end + 1), [begin], {begin}
        cost[begin] = 0.0
        for node in queue:
            queued.discard(node)
            for a in heads[node]:
                to, room, price, _ = arcs[a]
                if room > least and cost[node] + price < cost[to] - 1e-12:
                    cost[to], via[to] = cost[node] + price, a
                    if to not in queued:
                        queued.add(to)
                        queue.append(to)
        if math.isinf(cost[end]):
            break
        path, node = [], end
        while node != begin:
            path.append(via[node])
            node = arcs[arcs[via[node]][3]][0]
        push = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= push
            arcs[arcs[a][3]][1] += push
    return [{s: arcs[arcs[a][3]][1] for s, a in g.items()} for g in given]


def fill(items: pd.DataFrame, room: float) -> pd.Series:
    """How many of each item's copies fit, in hash order; then the best last one."""
    items = items.sort_values(["pos", "item"])
    got = {}
    for at, size, copies in zip(items.index, items["size"], items["copies"]):
        taken = min(int(copies), int(room // size)) if size > 0 else 0
        got[at] = taken
        room -= taken * size
    rest = [(abs(room - s), at) for at, s, c in zip(items.index, items["size"], items["copies"]) if s > 0 and got[at] < c]
    if rest and min(rest)[0] < room:
        got[min(rest)[1]] += 1
    return pd.Series(got)


def choose(items: DataFrame, rests: dict[int, float]) -> DataFrame:
    """(item, extra): copies of items taken so that each pattern's sizes come near its rest.

    ``items`` has (item, pattern, pos, size, copies). Every pattern's hash range is
    narrowed to the bucket where the rest runs out; all before it is taken.
    """
    spark = items.sparkSession
    if not rests:
        return items.selectExpr("item", "copies AS extra").where("false")
    spans = {p: [0, HASHES, rest, None] for p, rest in rests.items()}

    def table() -> DataFrame:
        rows = [(p, lo, hi, float(rest), n or 0) for p, (lo, hi, rest, n) in spans.items()]
        return F.broadcast(  # one row for each pattern
            spark.createDataFrame(rows, "pattern int, lo bigint, hi bigint, rest double, n bigint")
        )

    counts = items.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    for p, n in counts:
        if p in spans:
            spans[p][3] = n
    while any((n or 0) > FEW and hi - lo > 1 for lo, hi, _, n in spans.values()):
        inside = items.join(table(), "pattern").where("pos >= lo AND pos < hi")
        split = inside.withColumn(
            "width", F.expr(f"CASE WHEN n > {FEW} THEN greatest(1L, (hi - lo) DIV least({BUCKETS}, n DIV {FEW // 2})) ELSE hi - lo END")
        ).withColumn("bucket", F.expr("lo + (pos - lo) DIV width * width"))
        sums = split.groupBy("pattern", "bucket", "width", "hi", "rest").agg(
            F.expr("sum(size * copies) AS total"), F.count("*").alias("n")
        )
        found = (
            sums.withColumn("upto", F.expr("sum(total) OVER (PARTITION BY pattern ORDER BY bucket)"))
            .where("upto > rest")
            .groupBy("pattern")
            .agg(F.min_by(F.struct("bucket", "width", "hi", "upto", "total", "n"), "bucket").alias("b"))
            .select("pattern", "b.*")
            .collect()  # one row for each pattern
        )
        crossed = {r.pattern: r for r in found}
        for p, span in spans.items():
            if p in crossed:
                r = crossed[p]
                spans[p] = [r.bucket, min(r.bucket + r.width, r.hi), span[2] - (r.upto - r.total), r.n]
            else:  # all that is inside fits
                spans[p] = [span[1], span[1], 0.0, 0]
    placed = items.join(table(), "pattern")
    whole = placed.where("pos < lo").selectExpr("item", "copies AS extra")

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        got = fill(rows, float(rows["rest"].iloc[0]))
        return pd.DataFrame({"item": rows["item"], "extra": got.reindex(rows.index)}).astype("int64")

    border = placed.where("pos >= lo AND pos < hi").groupBy("pattern").applyInPandas(last, "item bigint, extra bigint")
    return whole.unionByName(border).where("extra > 0")


def mix_sources(
    docs: DataFrame,
    size: str,
    members: str,
    weights: Sequence[float] = (5, 2, 1),
    most_rounds: int = 3,
    seed: int = 17,
) -> DataFrame:
    """``docs`` and a struct ``mix`` (size, source_size, target, times): how often rows are taken.

    ``size`` and ``members`` (an array of source names) are SQL expressions. Sources in
    code point order, null last, weigh ``weights`` in turn. ``source_size`` and ``target``
    are those of the row's first source. Rows are told apart by all their columns.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    key = free_name(docs.columns, "_content")
    every = ", ".join(quoted(c) for c in docs.columns)
    keyed = docs.withColumn(key, F.expr(f"struct(xxhash64({every}) AS a, hash({every}) AS b)"))
    units = scratch.stage(
        keyed.selectExpr(
            f"{key} AS content", f"CAST({size} AS BIGINT) AS size",
            f"array_sort(array_distinct({members})) AS members",
        ).groupBy("content", "size", "members").agg(F.count("*").alias("copies")),
        "units",
    )
    patterns = units.groupBy("members").agg(F.expr("sum(size * copies) AS total")).collect()
    sources = sorted({s for r in patterns for s in r.members}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    # a document of several sources adds to the size of each
    sizes = [sum(r.total for r in patterns if s in r.members) for s in sources]
    quotas = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sources))], most_rounds)
    flows = route(
        [r.total for r in patterns], [[number[s] for s in r.members] for r in patterns], quotas, most_rounds
    )
    rows, rests = [], {}
    for p, (r, flow) in enumerate(zip(patterns, flows)):
        given = sum(flow.values())
        rounds = min(int(given / r.total + 1e-9), most_rounds) if r.total else 0
        if r.total and rounds < most_rounds and given - rounds * r.total > 1e-6:
            rests[p] = given - rounds * r.total
        first = number[r.members[0]]
        rows.append((p, r.members, rounds, int(sizes[first]), float(quotas[first])))
    plan = spark.createDataFrame(
        rows, "pattern int, members array<string>, rounds int, source_size bigint, target double"
    ).withColumn("of", F.to_json(F.struct("members")))
    numbered = (
        units.withColumn("of", F.to_json(F.struct("members")))
        .join(F.broadcast(plan.drop("members")), "of")  # one row for each pattern
        .selectExpr(
            "content", "xxhash64(content.a, content.b) AS item", "pattern", "size", "copies", "rounds",
            "source_size", "target", f"shiftrightunsigned(xxhash64({seed}, content.a, content.b), 2) AS pos",
        )
    )
    chosen = choose(numbered.select("item", "pattern", "pos", "size", "copies"), rests)
    decided = scratch.stage(
        numbered.drop("pos").join(chosen, "item", "left").selectExpr(
            "content", "size", "source_size", "target", "copies", "rounds", "coalesce(extra, 0) AS extra"
        ),
        "decided",
    )
    # of equal rows some may be taken once more and some not: few units, at the border only
    parted = decided.where("extra > 0 AND extra < copies")
    even = decided.where("extra = 0 OR extra = copies").withColumn("more", F.expr("if(extra > 0, 1, 0)"))

    def attached(units: DataFrame, more: str) -> DataFrame:
        mix = f"struct(size, source_size, target, rounds + {more} AS times) AS mix"
        found = units.selectExpr("content", mix, "extra AS _extra")
        return keyed.join(found, keyed[key] == found["content"])

    numbered_rows = attached(parted, "0").withColumn(
        "_at", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY {key})")
    )
    columns = [quoted(c) for c in docs.columns]
    return attached(even, "more").selectExpr(*columns, "mix").unionAll(
        numbered_rows.selectExpr(
            *columns,
            "struct(mix.size, mix.source_size, mix.target, mix.times + if(_at <= _extra, 1, 0) AS times) AS mix",
        )
    )


def take(mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each taken row as often as it is taken, without ``mix``."""
    return (
        mixed.where("mix.times > 0")
        .withColumn("mix", F.expr("explode(sequence(1, mix.times))"))
        .drop("mix")
    )
