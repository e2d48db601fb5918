"""Personal data by weak supervision, in SQL expressions only.

Base patterns give certain spans. Looser patterns propose further ones, and labelers vote
on every candidate with +1, 0 or -1: a shape check, a gazetteer, the words before it and
the characters around it. Votes are counted over the corpus; expectation-maximisation over
the counts estimates how reliable each labeler is and how likely each vote pattern is
personal data. With these soft labels a naive Bayes classifier of span features is trained,
and candidates it finds likely are added to the base spans.

Whole texts are searched; offsets are code points, the end exclusive. A null text is
empty; empty tables give no rows; repeated rows give repeated results. Patterns use
possessive loops and cannot backtrack or recurse over long runs.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch, free_name

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("shape", "gazetteer", "before", "around")

# Base patterns. A match may not start inside a run it could have started earlier in, so
# the looks behind change no result; they keep the search linear in long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Proposals beyond the base: (kind, pattern)
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
              r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("secret", r"(?i)(?:token|password|passwd|secret|api[_-]?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_-]{16,}+"),
)
GATES = {
    "email": "instr(text, '@') > 0",
    "ip": "has_digit AND instr(text, '.') > 0",
    "card": "has_digit",
    "phone": "has_digit AND instr(text, '+') > 0",
    "loose email": "instr(text, 'at)') > 0 OR instr(text, 'at]') > 0",
    "loose phone": "has_digit",
    "loose secret": "instr(text, '=') > 0 OR instr(text, ':') > 0",
}
#: fixed values: top-level domains, card issuer digits, and words that announce a kind
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us")
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CUES = {
    "email": "mail|contact|write|reply|schreib|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|adresse|direcci",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|llama|appel",
    "secret": "token|password|passwd|secret|key",
}
ELSE = r"version|order|invoice|isbn|serial|\bno\.|\bid\b"


def _prefix(sizes: str) -> str:
    """Exclusive running sums of an array, by chunks, so that long arrays stay cheap."""
    chunks = f"transform(sequence(0, (size({sizes}) - 1) DIV 256), c -> slice({sizes}, c * 256 + 1, 256))"
    inner = f"transform({chunks}, q -> aggregate(q, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x))))"
    return (
        f"flatten(aggregate({inner}, "
        "named_struct('base', 0, 'out', CAST(array() AS ARRAY<ARRAY<INT>>)), "
        "(a, q) -> named_struct('base', a.base + element_at(q, -1), "
        "'out', concat(a.out, array(transform(slice(q, 1, size(q) - 1), x -> x + a.base))))).out)"
    )


def _spans(df: DataFrame, name: str, kind: str, pattern: str, gate: str) -> DataFrame:
    """Adds ``name``: array of (kind, s, e, m, l, r) of the leftmost non-overlapping matches."""
    text = F.col("text")
    df = df.withColumn(
        "_m", F.when(F.expr(gate), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    ).withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn(
        "_at",
        F.when(
            F.size("_m") > 0,
            F.expr(_prefix("transform(_m, (m, i) -> length(m) + length(_p[i]))")),
        ),
    )
    found = (
        f"transform(_m, (m, i) -> named_struct('kind', '{kind}', 's', _at[i] + length(_p[i]), "
        "'e', _at[i] + length(_p[i]) + length(m), 'm', m, "
        "'l', lower(right(_p[i], 40)), 'r', left(_p[i + 1], 40)))"
    )
    return df.withColumn(
        name, F.expr(f"CASE WHEN size(_m) > 0 THEN {found} ELSE array() END")
    ).drop("_m", "_p", "_at")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (t, i) -> t + CASE WHEN (length({d}) - i) % 2 = 1 "
    "THEN 2 * CAST(substring({d}, i, 1) AS INT) - if(CAST(substring({d}, i, 1) AS INT) > 4, 9, 0) "
    "ELSE CAST(substring({d}, i, 1) AS INT) END) % 10 = 0"
).format(d=_DIGITS)
_OCTETS = "forall(split(x.m, '[.]'), p -> length(trim(LEADING '0' FROM p)) < 4 AND CAST('0' || trim(LEADING '0' FROM p) AS INT) < 256)"
VALID = {
    "email": "true",
    "ip": _OCTETS,
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
SHAPE = {
    "email": "if(x.m RLIKE '[.)][A-Za-z]{2,10}$', 1, -1)",
    "ip": f"if({_OCTETS}, 1, -1)",
    "card": f"if({_LUHN}, 1, -1)",
    "phone": f"if(length({_DIGITS}) BETWEEN 9 AND 15, 1, -1)",
    "secret": "if(x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]{4}', 1, -1)",
}
GAZETTEER = {
    "email": f"if(lower(x.m) RLIKE '[.)] ?(?:{'|'.join(DOMAINS)})$', 1, 0)",
    "ip": "if(x.m RLIKE '^(?:0|22[4-9]|2[3-9][0-9])[.]', -1, 0)",
    "card": f"if(x.m RLIKE '{ISSUERS}', 1, -1)",
    "phone": "if(x.m RLIKE '^[+](?:1|3[0-9]|4[0-9])', 1, 0)",
    "secret": "if(x.m RLIKE '[0-9a-fA-F]{32}', 1, 0)",
}


def _by_kind(cases: dict[str, str]) -> str:
    return "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END"


def _votes() -> str:
    cue = {
        k: f"CASE WHEN x.l RLIKE r'{v}' THEN 1 WHEN x.l RLIKE r'{ELSE}' THEN -1 ELSE 0 END"
        for k, v in CUES.items()
    }
    around = (
        "CASE WHEN x.l RLIKE r'[\\p{L}\\p{N}_]$' OR x.r RLIKE r'^[\\p{L}\\p{N}_]' THEN -1 "
        "WHEN x.r = '' OR x.r RLIKE r'^[\\s.,;:!?)\"]' THEN 1 ELSE 0 END"
    )
    return f"array({_by_kind(SHAPE)}, {_by_kind(GAZETTEER)}, {_by_kind(cue)}, {around})"


def _features() -> str:
    """Bounded categorical features of a span, one text each."""
    edge = (
        "CASE WHEN {c} = '' THEN 'none' WHEN {c} RLIKE r'^\\p{{L}}$' THEN 'letter' "
        "WHEN {c} RLIKE '^[0-9]$' THEN 'digit' WHEN {c} RLIKE r'^\\s$' THEN 'blank' ELSE 'sign' END"
    )
    return (
        "array('kind=' || x.kind, "
        f"'digits=' || CAST(least(length({_DIGITS}), 20) AS STRING), "
        "'length=' || CAST(least(length(x.m) DIV 4, 15) AS STRING), "
        "'sep=' || CASE WHEN x.m RLIKE '[(]' THEN 'bracket' WHEN x.m RLIKE ' ' THEN 'blank' "
        "WHEN x.m RLIKE '-' THEN 'dash' ELSE 'none' END, "
        f"'left=' || {edge.format(c='right(x.l, 1)')}, "
        f"'right=' || {edge.format(c='left(x.r, 1)')}, "
        f"'cue=' || CAST({_by_kind({k: f'''x.l RLIKE r'{v}' ''' for k, v in CUES.items()})} AS STRING))"
    )


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more): base spans and further candidates with votes and features."""
    df = docs.selectExpr(
        f"{quoted(id_col)} AS doc_id", f"coalesce(CAST({quoted(text_col)} AS STRING), '') AS text"
    ).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    for kind in BASE:
        df = _spans(df, f"_{kind}", kind, BASE[kind], GATES[kind])
    for n, (kind, pattern) in enumerate(LOOSE):
        df = _spans(df, f"_loose{n}", kind, pattern, GATES[f"loose {kind}"])
    df = df.drop("text", "has_digit")
    base = ", ".join(f"filter(_{k}, x -> {VALID[k]})" for k in BASE)
    more = ", ".join(
        [f"filter(_card, x -> length({_DIGITS}) BETWEEN 12 AND 19)"]
        + [f"_loose{n}" for n in range(len(LOOSE))]
    )
    voted = (
        "transform({a}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, "
        f"'votes', {_votes()}, 'features', {_features()}))"
    )
    apart = "filter(_more, x -> NOT exists(_base, b -> b.s < x.e AND x.s < b.e))"
    return (
        df.selectExpr("doc_id", f"concat({base}) AS _base", f"concat({more}) AS _more")
        .selectExpr("doc_id", "_base", f"if(size(_more) > 0, {apart}, _more) AS _more")
        .selectExpr(
            "doc_id", f"{voted.replace('{a}', '_base')} AS base", f"{voted.replace('{a}', '_more')} AS more"
        )
    )


def estimate_reliabilities(counts: dict[tuple, float], rounds: int = 50) -> dict[tuple, float]:
    """EM over vote-pattern counts of one kind: probability that each pattern is real.

    Votes are independent given the truth. Smoothing starts every labeler as somewhat
    better than chance, which also fixes which of the two classes is the real one.
    """
    total = sum(counts.values())
    prior = 0.5
    start = {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.1, 0: 0.3, -1: 0.6}}
    rate = {real: [dict(start[real]) for _ in LABELERS] for real in start}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for votes in counts:
            yes = math.log(prior) + sum(math.log(rate[True][i][v]) for i, v in enumerate(votes))
            no = math.log(1 - prior) + sum(math.log(rate[False][i][v]) for i, v in enumerate(votes))
            posterior[votes] = 1 / (1 + math.exp(min(no - yes, 700)))
        real_mass = sum(n * posterior[v] for v, n in counts.items())
        prior = min(max((real_mass + 1) / (total + 2), 1e-6), 1 - 1e-6)
        for real in rate:
            mass = {v: n * (posterior[v] if real else 1 - posterior[v]) for v, n in counts.items()}
            whole = sum(mass.values())
            for i in range(len(LABELERS)):
                for vote in (1, 0, -1):
                    got = sum(m for v, m in mass.items() if v[i] == vote)
                    rate[real][i][vote] = (got + 4 * start[real][vote]) / (whole + 4)
    return posterior


def train_classifier(patterns: list[tuple]) -> tuple[float, dict[str, float]]:
    """(bias, weight of each feature) of naive Bayes on EM's soft labels.

    ``patterns`` has (kind, votes, features, count) rows, a table bounded by the numbers
    of votes and feature values, not by the corpus.
    """
    by_kind: dict[str, dict[tuple, float]] = defaultdict(lambda: defaultdict(float))
    for kind, votes, _, n in patterns:
        by_kind[kind][tuple(votes)] += n
    soft = {k: estimate_reliabilities(c) for k, c in by_kind.items()}
    real, fake = defaultdict(float), defaultdict(float)
    real_n = fake_n = 1.0
    for kind, votes, features, n in patterns:
        p = soft[kind][tuple(votes)]
        real_n, fake_n = real_n + n * p, fake_n + n * (1 - p)
        for f in features:
            real[f] += n * p
            fake[f] += n * (1 - p)
    weights = {
        f: math.log((real[f] + 0.5) / (real_n + 1)) - math.log((fake[f] + 0.5) / (fake_n + 1)) for f in real
    }
    return math.log(real_n / fake_n), weights


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (s, kind_no, e, kind), sorted by start, then kind."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.stage(candidate_spans(docs, id_col, text_col), "candidates")
    patterns = [
        (r.kind, r.votes, r.features, float(r.n))
        for r in found.selectExpr("explode(concat(base, more)) AS x")
        .groupBy("x.kind", "x.votes", "x.features")
        .agg(F.count("*").alias("n"))
        .collect()
    ]
    bias, weights = train_classifier(patterns)
    listed = "array_sort(transform({a}, x -> named_struct('s', x.s, 'kind_no', CAST(" + _by_kind(
        {k: str(n) for n, k in enumerate(KINDS)}
    ) + " AS INT), 'e', x.e, 'kind', x.kind)))"
    likely = _likely(bias, weights)
    return found.withColumn("added", likely).selectExpr(
        "doc_id", f"{listed.replace('{a}', 'base')} AS base", f"{listed.replace('{a}', 'concat(base, added)')} AS spans"
    )


def _likely(bias: float, weights: dict[str, float]) -> Column:
    if not weights:
        return F.col("more")
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])

    def score(x: Column) -> Column:
        return F.aggregate(
            x["features"], F.lit(bias), lambda t, f: t + F.coalesce(F.element_at(table, f), F.lit(0.0))
        )

    return F.when(F.size("more") > 0, F.filter("more", lambda x: score(x) >= 0)).otherwise(F.col("more"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets.

    Overlapping spans become one mark, named after the first. Spans are brought back to
    their rows by id and text hash, so repeated ids with different texts stay apart.
    """
    text = quoted(text_col)
    key, marked = free_name(docs.columns, "_key"), free_name(docs.columns, "_spans")
    keyed = docs.withColumn(key, F.expr(f"struct(xxhash64({text}) AS a, length({text}) AS b, {quoted(id_col)} AS c)"))
    spans = find_personal_data(keyed, key, text_col).where("size(spans) > 0").dropDuplicates(["doc_id"])
    merged = (
        "aggregate(spans, CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, kind: STRING>>), (a, x) -> "
        "CASE WHEN size(a) > 0 AND x.s < element_at(a, -1).e THEN concat(slice(a, 1, size(a) - 1), "
        "array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), "
        "'kind', element_at(a, -1).kind))) "
        "ELSE concat(a, array(named_struct('s', x.s, 'e', x.e, 'kind', x.kind))) END)"
    )
    rebuilt = (
        f"concat(array_join(transform({marked}, (x, i) -> concat(substring({text}, "
        f"if(i = 0, 0, {marked}[i - 1].e) + 1, x.s - if(i = 0, 0, {marked}[i - 1].e)), "
        f"'<', upper(x.kind), '>')), ''), substring({text}, element_at({marked}, -1).e + 1))"
    )
    marks = spans.selectExpr(f"doc_id AS {marked}_key", f"{merged} AS {marked}")
    return (
        keyed.join(marks, keyed[key].eqNullSafe(marks[f"{marked}_key"]), "left")
        .withColumn(text_col, F.expr(f"CASE WHEN {marked} IS NULL THEN {text} ELSE {rebuilt} END"))
        .select(*[F.col(quoted(c)) for c in docs.columns])
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their SHA-256, and all spans as text."""
    text = "array_join(transform({a}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    counts = [f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE]
    return found.selectExpr(
        "doc_id", *counts, f"sha2({text.replace('{a}', 'base')}, 256) AS base_sha256",
        f"{text.replace('{a}', 'spans')} AS spans",
    )
