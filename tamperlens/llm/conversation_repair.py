"""Repair of conversation structure by generalised LR parsing with weighted edits.

The role grammar is: a conversation is empty, turns, or a system row and turns; turns are
one or more pairs of a user and an assistant row. Its LR automaton reduces every pair as
soon as it is complete, so the top of a parse stack is one of four: nothing yet, a system
row, turns, or a user row that waits for its answer. All stacks of a conversation form a
graph: a node for each top after each row, linked to the nodes it came from by an edit of
that row, with inserted rows before it. Stacks that meet in a top are merged and only the
link of the smallest (cost, audit) is kept: what may follow depends on the top alone.

The audit spells the edits: K keep, R rerole, D delete, I insert. Inserts belong to the row
they precede, so what a row adds is I* and one other letter, a prefix code: comparing
audits of one length in rows is comparing the first row in which they differ, and the
order of the tops' audits is carried as a rank. As costs and ranks only matter relative to
each other, few different sets of tops occur, and their steps are remembered.

A conversation's rows are sorted by turn (nulls first), role and text and pass through a
task as a stream: it holds one byte a row and top for the audit, one running SHA-256 for
each top, and no text. Each conversation needs one pass in order, because its digest is
one of its whole text. Repeated rows are found by Spark in the same partitioning.

Null roles and texts are one space. A null conversation id is a conversation like any
other. An empty role fits nowhere and must be reroled or deleted. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import bounded_batches

#: fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: fixed values: blanks, and the characters that end a sentence
BLANKS, ENDS = r"[\x20\x09-\x0D]", "[.!?]"

NOTHING, SYSTEM, USER, TURNS = range(4)
TOPS = 4
#: (top, role initial) -> top after the row; "a" completes a pair, which is reduced at once
MOVES = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER,
    (TURNS, "u"): USER, (USER, "a"): TURNS,
}
ACCEPTED = (NOTHING, TURNS)
NAMES = {"u": "user", "a": "assistant"}
SOUND, CUT, UNFIT = range(3)  # a row to keep, a truncated one, one that must go

SUMMARY = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) of ``conversations`` with planted faults.

    crc32 of "conv_id:turn" modulo 20 decides: 0 drops the row (it stays, not present, so
    that its conversation is known), 1 empties its text, 2 removes its sentence ends, 3
    repeats it, 4 makes its role user.
    """
    key = "concat_ws(':', coalesce(CAST(conv_id AS STRING), ' '), coalesce(CAST(turn AS STRING), ' '))"
    return (
        rows.selectExpr(
            "conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32({key}) % 20 AS harm"
        )
        .selectExpr(
            "conv_id", "turn", "if(harm = 4, 'user', role) AS role",
            f"CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '{ENDS}', '') ELSE text END AS text",
            "harm <> 0 AS present", "explode(sequence(1, if(harm = 3, 2, 1))) AS copy",
        )
        .drop("copy")
    )


def _inserts(top: int) -> list[tuple[int, str]]:
    """(top, role initials) reached from ``top`` by inserting; longer ones only go round."""
    first = {NOTHING: "u", SYSTEM: "u", TURNS: "u", USER: "a"}[top]
    then = {"u": "a", "a": "u"}[first]
    one = MOVES[top, first]
    return [(top, ""), (one, first), (MOVES[one, then], first + then)]


def _step(tops: tuple, initial: str, state: int) -> tuple:
    """One row: (least cost, tops after it, links).

    ``tops`` has (cost above the least, rank of the audit) for each top, or None. A link is
    (top before, inserted initials, edit letter, role initial it gets or "").
    """
    best: dict[int, tuple] = {}
    for top, known in enumerate(tops):
        if known is None:
            continue
        for reached, added in _inserts(top):
            paid = known[0] + INSERT * len(added)
            edits = [(reached, "D", "", DELETE)]
            if state != UNFIT:
                extra = TRUNCATED if state == CUT else 0
                if (reached, initial) in MOVES:
                    edits.append((MOVES[reached, initial], "K", initial, extra))
                for other in NAMES:
                    if (reached, other) in MOVES:
                        edits.append((MOVES[reached, other], "R", other, REROLE + extra))
            for after, letter, role, price in edits:
                offer = (paid + price, known[1], "I" * len(added) + letter, top, added, letter, role)
                if after not in best or offer[:3] < best[after][:3]:
                    best[after] = offer
    least = min(o[0] for o in best.values())
    ranks = {x: n for n, x in enumerate(sorted(o[1:3] for o in best.values()))}
    after = tuple(
        (best[t][0] - least, ranks[best[t][1:3]]) if t in best else None for t in range(TOPS)
    )
    links = tuple(best[t][3:] if t in best else None for t in range(TOPS))
    return least, after, links


class Parse:
    """One conversation's stacks, from row to row."""

    #: steps met so far; costs and ranks are relative, so few differ
    STEPS: dict[tuple, tuple] = {}
    #: every link that occurs, as a number of one byte
    LINKS: dict[tuple, int] = {}
    BY_NUMBER: list[tuple] = []

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.tops: tuple = ((0, 0), None, None, None)
        self.digests = [hashlib.sha256(), None, None, None]
        self.cost = 0
        self.audit = [bytearray() for _ in range(TOPS)]
        self.gaps = [None, None, 0]  # least turn, greatest turn, distinct turns
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.initial = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            if self.gaps[1] is None:
                self.gaps[0] = turn
            self.gaps[2] += turn != self.gaps[1]
            self.gaps[1] = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        state = {"": SOUND, "truncated": CUT}.get(fault, UNFIT)
        step = (self.tops, initial if initial in "sua" else "", state)
        if step not in self.STEPS:
            self.STEPS[step] = _step(*step)
        least, self.tops, links = self.STEPS[step]
        self.cost += least
        content = text.encode("utf-8", "surrogatepass")
        digests = []
        for top, link in enumerate(links):
            digests.append(self._hashed(link, role, content) if link else None)
            self.audit[top].append(self._number(link) if link else 0)
        self.digests = digests

    def _number(self, link: tuple) -> int:
        if link not in self.LINKS:
            self.LINKS[link] = len(self.BY_NUMBER)
            self.BY_NUMBER.append(link)
        return self.LINKS[link]

    def _hashed(self, link: tuple, role: str, content: bytes):
        before, added, letter, to = link
        found = self.digests[before].copy()
        # every row but the first follows a line end; only the top "nothing" has no row
        parts = [NAMES[i].encode() + b":" for i in added]
        if letter != "D":
            parts.append((role if letter == "K" else NAMES[to]).encode("utf-8", "surrogatepass") + b":" + content)
        if parts:
            found.update((b"" if before == NOTHING else b"\n") + b"\n".join(parts))
        return found

    def close(self) -> tuple:
        """The row of the summary."""
        ends = []
        for top, known in enumerate(self.tops):
            if known is not None:
                for reached, added in _inserts(top):
                    if reached in ACCEPTED:
                        ends.append((known[0] + INSERT * len(added), known[1], len(added), top, added))
        cost, _, _, top, added = min(ends)
        digest = self._hashed((top, added, "D", ""), "", b"")
        letters = ["I" * len(added)]
        at = top
        for row in range(len(self.audit[0]) - 1, -1, -1):
            before, inserted, letter, _ = self.BY_NUMBER[self.audit[at][row]]
            letters.append("I" * len(inserted) + letter)
            at = before
        first, last, distinct = self.gaps
        return (
            self.conv_id, 0 if first is None else last - first + 1 - distinct,
            self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal,
            self.cost + cost, "".join(reversed(letters)), digest.hexdigest(),
        )


def marked(
    rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: str | None
) -> DataFrame:
    """Rows (conv_id, turn, role, text, present, fault) in order within each conversation.

    One shuffle by conversation serves the search for repeated rows and the order.
    """
    last = rf"regexp_extract(text, r'([^\x20\x09-\x0D]){BLANKS}*\z', 1)"
    return (
        rows.selectExpr(
            f"CAST({quoted(conv_col)} AS BIGINT) AS conv_id",
            f"CAST({quoted(turn_col)} AS BIGINT) AS turn",
            f"coalesce({quoted(role_col)}, ' ') AS role",
            f"coalesce({quoted(text_col)}, ' ') AS text",
            f"{quoted(present)} AS present" if present else "true AS present",
        )
        .withColumn("digest", F.expr("sha2(text, 256)"))
        .withColumn("final", F.expr(last))
        .repartition("conv_id")
        # rows that are not present come last, so they are never the first of their kind
        .withColumn(
            "seen",
            F.expr("row_number() OVER (PARTITION BY conv_id, role, digest ORDER BY NOT present, turn NULLS FIRST) > 1"),
        )
        .selectExpr(
            "conv_id", "turn", "role", "text", "present",
            "CASE WHEN final = '' THEN 'blank' WHEN seen THEN 'duplicate' "
            f"WHEN final NOT RLIKE '{ENDS}' THEN 'truncated' ELSE '' END AS fault",
        )
        # of equal rows the one that is no repetition comes first
        .sortWithinPartitions("conv_id", "turn", "role", "text", F.expr("fault = 'duplicate'"))
    )


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: str | None = None,
) -> DataFrame:
    """One row per conversation: faults, cost and audit of the cheapest repair, its digest.

    ``present`` names a boolean column of rows that count; the others only make their
    conversation known. :func:`apply_repairs` gives the repaired rows.
    """
    bounded_batches(rows.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, done = None, []
        for frame in frames:
            for conv_id, turn, role, text, there, fault in zip(*[c.to_pylist() for c in frame.columns]):
                if parse is None or conv_id != parse.conv_id:
                    if parse is not None:
                        done.append(parse.close())
                    parse = Parse(conv_id)
                if there:
                    parse.add(turn, role, text, fault)
            if done:
                yield _batch(done)
                done = []
        if parse is not None:
            yield _batch([parse.close()])

    return marked(rows, conv_col, turn_col, role_col, text_col, present).mapInArrow(run, SUMMARY)


def _batch(done: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def apply_repairs(
    rows: DataFrame,
    repairs: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: str | None = None,
) -> DataFrame:
    """Rows (conv_id, place, edit, turn, role, text): conversations as the audits repair them.

    ``place`` counts from 0; inserted rows have a null turn and empty text. Conversations
    repaired to nothing have no rows.
    """
    ordered = marked(rows, conv_col, turn_col, role_col, text_col, present).where("present").selectExpr(
        "conv_id", "turn", "role", "text",
        "row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, fault = 'duplicate') AS row_no",
    )
    repaired = repairs.where("audit <> ''").selectExpr("conv_id", "posexplode(split(audit, '')) AS (at, edit)")
    # of each letter: the row it edits, and its place among the rows that stay
    edits = repaired.where("edit <> ''").selectExpr(
        "conv_id", "edit",
        "sum(if(edit = 'I', 0, 1)) OVER (PARTITION BY conv_id ORDER BY at) AS row_no",
        "sum(if(edit = 'D', 0, 1)) OVER (PARTITION BY conv_id ORDER BY at) - 1 AS place",
    )
    kept = (
        edits.where("edit IN ('K', 'R')")
        .withColumnsRenamed({"conv_id": "_conv", "row_no": "_row"})
        .join(ordered, F.expr("_conv <=> conv_id AND _row = row_no"))
    )
    both = kept.select("conv_id", "place", "edit", "turn", "role", "text").unionByName(
        edits.where("edit = 'I'").selectExpr(
            "conv_id", "place", "edit", "CAST(NULL AS BIGINT) AS turn", "'' AS role", "'' AS text"
        )
    )
    # users stand at even places, or at odd ones behind a kept system row
    shift = "max(if(place = 0 AND edit = 'K' AND left(role, 1) = 's', 1, 0)) OVER (PARTITION BY conv_id)"
    return both.selectExpr("*", f"{shift} AS shift").selectExpr(
        "conv_id", "place", "edit", "turn",
        "CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "text",
    )
