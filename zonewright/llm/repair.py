r"""Conversations brought back into the form ``(s?(ua)+)?`` by the cheapest edits.

Repair items are deductions of a weighted hypergraph. Within a stretch of rows an item says: the
rows so far are edited, and the roles that are left bring the grammar from one state to another.
Rules keep, rerole or delete the next row, or insert a turn before it. Spans over neighbouring
stretches are joined by a rule with two premises. The weight of an item is (cost, audit); costs
add up and audits, the initials of the edits, are joined. Given the rows and the state a
derivation starts in, its audit determines its cost, so of two equally cheap audits none is a
prefix of the other, and every rule is monotone and superior in the order by cost, then text.
Knuth's agenda therefore finalises each item when it is popped for the first time.

1. Equal rows of a conversation become one with a count; rows are range-partitioned and sorted by
   conversation and turn, so that a long conversation spreads over several tasks.
2. A task cuts its rows into conversations. One that lies whole within is repaired on the spot. The
   first and last of a task may go on in its neighbours; they and long ones become open blocks.
3. Rows of open blocks that repeat one of an earlier block are found by their digests. Each block
   then gives its lightest span for each pair of states, the spans of a conversation are joined in
   a balanced tree, and each block learns its part of the audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import keep

#: Most rows and most characters of a block.
BLOCK, BLOCK_CHARS = 512, 4 << 20

# Costs of the edits, the grammar, white space, and how a sentence ends.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
_BLANK, _STOPS = " \t\n\v\f\r", ".!?"

Weight = tuple[int, str]


def lightest(
    axioms: Iterable[tuple[Weight, tuple]],
    conclude: Callable[[tuple, Weight, dict], Iterable[tuple[Weight, tuple]]],
    goals: tuple = (),
) -> tuple[dict, tuple | None]:
    """Knuth's agenda: the lightest weight of every item, or of those up to the first goal.
    ``conclude(item, weight, done)`` gives the conclusions of the rules that have ``item`` as a
    premise and their other premises in ``done``."""
    agenda = list(axioms)
    heapq.heapify(agenda)
    done: dict[tuple, Weight] = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = weight
        if item in goals:
            return done, item
        for then in conclude(item, weight, done):
            if then[1] not in done:
                heapq.heappush(agenda, then)
    return done, None


@dataclass
class Row:
    """``n`` equal rows; ``repeated`` if an earlier row of the conversation is the same."""

    role: str
    text: str
    n: int
    turn: int | None = None
    repeated: bool = False

    @property
    def fault(self) -> str:
        said = self.text.strip(_BLANK)
        if not said:
            return "blank"
        if self.repeated:
            return "duplicate"
        return "" if said[-1] in _STOPS else "truncated"

    def edits(self) -> list[list[tuple[str, int, str | None]]]:
        """For each step the (initials, cost, role initial that is left) to choose from."""
        more = [[("D" * (self.n - 1), DELETE * (self.n - 1), None)]] if self.n > 1 else []
        fault = self.fault
        if fault in ("blank", "duplicate"):
            return [[("D", DELETE, None)], *more]
        extra = TRUNCATED if fault else 0
        able = [("R", REROLE + extra, "u"), ("R", REROLE + extra, "a"), ("D", DELETE, None)]
        if self.role[:1]:
            able.append(("K", extra, self.role[:1]))
        return [able, *more]

    @property
    def digest(self) -> bytes:
        told = f"{len(self.role)}:{self.role}{self.text}".encode("utf-8", "surrogatepass")
        return hashlib.blake2b(told, digest_size=20).digest()


def _rules(steps: list, closing: bool):
    def conclude(item, weight, done):
        at, state = item
        cost, audit = weight
        if at < len(steps) or closing:
            for role in "ua":
                if (state, role) in MOVES:
                    yield (cost + INSERT, audit + "I"), (at, MOVES[state, role])
        if at < len(steps):
            for initials, more, role in steps[at]:
                to = state if role is None else MOVES.get((state, role))
                if to is not None:
                    yield (cost + more, audit + initials), (at + 1, to)

    return conclude


def repair_rows(rows: list[Row]) -> Weight:
    """The lightest repair of a whole conversation."""
    steps = [s for r in rows for s in r.edits()]
    goals = tuple((len(steps), state) for state in FINAL)
    done, goal = lightest([((0, ""), (0, START))], _rules(steps, True), goals)
    return done[goal]


def spans(rows: list[Row]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of the lightest way through a block for each pair of states.
    Turns are inserted before a row; what is inserted behind the last one belongs to the next
    block, or to the end."""
    steps = [s for r in rows for s in r.edits()]
    out = []
    for state in range(4):
        done, _ = lightest([((0, ""), (0, state))], _rules(steps, False))
        out += [(state, to, *done[at, to]) for at, to in done if at == len(steps)]
    return out


def join_spans(blocks: list[list[tuple[int, int, int, str]]]) -> Weight:
    """The lightest repair of a conversation in blocks, joined in a balanced tree of spans."""
    end = []
    for state in range(4):
        done, _ = lightest([((0, ""), (0, state))], _rules([], True))
        end += [(state, to, *done[0, to]) for to in FINAL if (0, to) in done]
    leaves = [*blocks, end]
    sizes = [len(leaves)]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 2))
    top = len(sizes) - 1

    def conclude(item, weight, done):
        level, k, a, b = item
        if level == top:
            return
        if k % 2:
            pairs = [((level, k - 1, p, a), (p, b)) for p in range(4)]
        elif k + 1 == sizes[level]:
            yield weight, (level + 1, k // 2, a, b)
            return
        else:
            pairs = [((level, k + 1, b, p), (a, p)) for p in range(4)]
        for other, ends in pairs:
            if other in done:
                left, right = (done[other], weight) if k % 2 else (weight, done[other])
                yield (left[0] + right[0], left[1] + right[1]), (level + 1, k // 2, *ends)

    axioms = [((c, w), (0, k, a, b)) for k, leaf in enumerate(leaves) for a, b, c, w in leaf]
    done, goal = lightest(axioms, conclude, tuple((top, 0, START, f) for f in FINAL))
    return done[goal]


def apply_edits(rows: list[Row], audit: str, state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that is left or inserted."""
    at = 0
    # what the grammar wants next is all that a rerole or insert can give
    wanted = lambda: "a" if state == USER else "u"
    for row in rows:
        for copy in range(row.n):
            while audit[at] == "I":
                role = wanted()
                yield "I", ROLES[role], ""
                state, at = MOVES[state, role], at + 1
            edit, at = audit[at], at + 1
            if edit == "D" and copy:
                at += row.n - copy - 1  # of equal rows all but the first are deleted
                break
            if edit != "D":
                initial = wanted() if edit == "R" else row.role[:1]
                yield edit, ROLES[initial] if edit == "R" else row.role, row.text
                state = MOVES[state, initial]
    for _ in audit[at:]:
        role = wanted()
        yield "I", ROLES[role], ""
        state = MOVES[state, role]


@dataclass
class Report:
    """Counts of a stretch of rows, and what is needed to join it with the next stretch."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None
    n: int = 0

    @classmethod
    def of(cls, rows: list[Row]) -> Report:
        out = cls()
        for row in rows:
            role, fault = row.role[:1], row.fault
            known = row.turn is not None
            one = cls(illegal=row.n - 1, turns=int(known), first_turn=row.turn, last_turn=row.turn,
                      first_role=role, last_role=role, n=row.n)
            # all but the first of equal rows are blank too, or else duplicates
            one.duplicate = 0 if fault == "blank" else row.n - 1
            if fault:
                setattr(one, fault, row.n if fault == "blank" else getattr(one, fault) + 1)
            out = out.then(one)
        return out

    def then(self, other: Report) -> Report:
        if not self.n or not other.n:
            return other if not self.n else self
        illegal = self.last_role + other.first_role not in LEGAL
        same = self.last_turn is not None and self.last_turn == other.first_turn
        return Report(
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + illegal,
            self.turns + other.turns - same,
            other.first_turn if self.first_turn is None else self.first_turn,
            self.last_turn if other.last_turn is None else other.last_turn,
            self.first_role,
            other.last_role,
            self.n + other.n,
        )

    @property
    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


_TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_REPORT = [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "n")]
_REPORT += [("first_role", pa.string()), ("last_role", pa.string())]
_TOLD = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()),
                  ("repeated", pa.bool_()), ("digest", pa.binary())])
_PLACE = [("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int64())]
BLOCKS = pa.schema([*_PLACE, ("told", pa.struct(_TOLD)), ("turns", pa.list_(_TURN)), ("rows", pa.list_(_ROW))])
SPANS = pa.schema([*_PLACE, ("report", pa.struct(_REPORT)),
                   ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
CHOSEN = pa.schema([*_PLACE, ("told", pa.struct(_TOLD)), ("state", pa.int32()), ("audit", pa.string())])
TURNS = pa.schema([*_PLACE, ("turns", pa.list_(_TURN))])


def _ddl(schema) -> str:
    """The same schema for Spark."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}

    def kind(t) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        if pa.types.is_struct(t):
            return "struct<" + ", ".join(f"{f.name}: {kind(f.type)}" for f in t) + ">"
        return names[t]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def _told(report: Report, weight: Weight) -> dict:
    counts = {n: getattr(report, n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")}
    return counts | {"cost": weight[0], "audit": weight[1]}


def _turns(rows: list[Row], audit: str, state: int) -> list[dict]:
    return [dict(zip(("edit", "role", "text"), t, strict=True)) for t in apply_edits(rows, audit, state)]


def _out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, len(batch), 1000):
            yield from batch.slice(a, 1000).to_pylist()


def _buffered(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, units = [], 0
    for row in rows:
        held.append(row)
        units += 1 + size(row)
        if units >= BLOCK_CHARS:
            yield _out(held, schema)
            held, units = [], 0
    if held:
        yield _out(held, schema)


def _chars(row: dict) -> int:
    return sum(len(t["text"]) + 100 for t in row["turns"] or row.get("rows") or ())


def _blocks(most: int):
    """Whole conversations with their repair, and open blocks, from sorted rows."""

    def cut(records: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        number = 0
        conv, rows, seen, chars = None, [], set(), 0
        first, split = True, False

        def block(whole: bool) -> dict:
            place = {"conv": conv, "part": part, "block": number}
            if whole:
                weight = repair_rows(rows)
                told = _told(Report.of(rows), weight)
                return {**place, "told": told, "turns": _turns(rows, weight[1], START), "rows": None}
            packed = [vars(r) | {"digest": r.digest} for r in rows]
            return {**place, "told": None, "turns": None, "rows": packed}

        for record in records:
            if rows and record["conv"] != conv:
                yield block(whole=not first and not split)
                number, first, split = number + 1, False, False
                rows, seen, chars = [], set(), 0
            elif len(rows) >= most or chars >= BLOCK_CHARS:
                split = True
                yield block(whole=False)
                number += 1
                rows, seen, chars = [], set(), 0
            conv = record["conv"]
            row = Row(record["role"], record["text"], record["n"], record["turn"])
            row.repeated = (row.role, row.text) in seen
            seen.add((row.role, row.text))
            rows.append(row)
            chars += len(row.text)
        if rows:  # the next task may go on with it
            yield block(whole=False)

    return lambda batches: _buffered(cut(_records(batches)), BLOCKS, _chars)


def _load(rows: list[dict], again: list[int] | None) -> list[Row]:
    again = set(again or ())
    return [
        Row(r["role"], r["text"], r["n"], r["turn"], r["repeated"] or i in again) for i, r in enumerate(rows)
    ]


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each():
        for r in _records(batches):
            rows = _load(r["rows"], r["again"])
            found = [dict(zip(("a", "b", "cost", "audit"), s, strict=True)) for s in spans(rows)]
            yield {n: r[n] for n in ("conv", "part", "block")} | {"report": vars(Report.of(rows)), "spans": found}

    return _buffered(each(), SPANS, lambda r: sum(len(s["audit"]) for s in r["spans"]))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair of each conversation, and for each of its blocks the state it begins in and its
    part of the audit. Blocks come sorted."""

    def joined(blocks: list[dict]) -> Iterator[dict]:
        found = [[(s["a"], s["b"], s["cost"], s["audit"]) for s in b["spans"]] for b in blocks]
        cost, audit = join_spans(found)
        report = Report()
        for b in blocks:
            report = report.then(Report(**b["report"]))
        letters = np.frombuffer(audit.encode(), np.uint8)
        ends = np.flatnonzero(letters != ord("I"))[np.cumsum([b["report"]["n"] for b in blocks]) - 1] + 1
        cuts = [0, *ends.tolist()]
        cuts[-1] = len(audit)  # what is inserted at the end belongs to the last block
        state, own = START, ""
        for k, b in enumerate(blocks):
            own = audit[cuts[k] : cuts[k + 1]]
            place = {n: b[n] for n in ("conv", "part", "block")}
            told = _told(report, (cost, audit)) if k == 0 else None
            yield place | {"told": told, "state": state, "audit": own}
            if k + 1 < len(blocks):
                state = next(to for a, to, _, w in found[k] if a == state and w == own)

    def each():
        held: list[dict] = []
        for r in _records(batches):
            if held and r["conv"] != held[0]["conv"]:
                yield from joined(held)
                held = []
            held.append(r)
        if held:
            yield from joined(held)

    return _buffered(each(), CHOSEN, lambda r: 2 * len(r["audit"]))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each():
        for r in _records(batches):
            place = {n: r[n] for n in ("conv", "part", "block")}
            yield place | {"turns": _turns(_load(r["rows"], None), r["audit"], r["state"])}

    return _buffered(each(), TURNS, _chars)


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    most_rows: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(reports, turns). Reports have a row per conversation: conv, gaps, blank, duplicate,
    truncated, illegal, cost and audit. Turns have the repaired conversation: conv, part, block
    and an array of (edit, role, text), edit being K, R or I; most conversations are one row,
    longer ones several, in the order of part and block.

    Rows are ordered by turn, null turns first, then by role and text. Equal rows are repeated
    turns. Null roles and texts count as empty, and a role without an initial is never kept. Rows
    with a null id make up one conversation. An empty table gives empty ones; other columns are
    not read, so their names do not matter. A conversation may have any number of rows; its
    audit, which is one value, must fit a task.
    """
    named = rows.select(
        col(conv_col).cast("long").alias("conv"),
        col(turn_col).cast("long").alias("turn"),
        *[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    counted = named.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions("conv", "turn", "role", "text")
    blocks = keep(ordered.mapInArrow(_blocks(most_rows), _ddl(BLOCKS)))
    whole = blocks.where("told is not null")
    # a null id is an id like any other, so joins go by a text that is never null
    own = F.coalesce(F.col("conv").cast("string"), F.lit(""))
    opened = blocks.where("told is null").select("conv", "part", "block", "rows", own.alias("key"))

    place = ["key", "part", "block"]
    said = opened.select(*place, F.posexplode("rows").alias("at", "r")).where("not r.repeated")
    said = said.select(*place, "at", F.col("r.digest").alias("digest"))
    first = said.groupBy("key", "digest").agg(F.min(F.struct("part", "block")).alias("first"), F.count("*").alias("n"))
    again = (
        said.join(first.where("n > 1"), ["key", "digest"])
        .where(F.struct("part", "block") != F.col("first"))
        .groupBy(*place)
        .agg(F.collect_list("at").alias("again"))
    )
    spanned = opened.join(again, place, "left").select("conv", "part", "block", "rows", "again")
    found = spanned.mapInArrow(_span_rows, _ddl(SPANS))
    chosen = keep(
        found.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(_join, _ddl(CHOSEN))
    )
    parts = chosen.select(own.alias("key"), "part", "block", "state", "audit")
    late = opened.join(parts, place).select("conv", "part", "block", "rows", "state", "audit")

    reports = whole.unionByName(chosen.where("told is not null"), allowMissingColumns=True)
    turns = whole.select("conv", "part", "block", "turns")
    return (
        reports.select("conv", "told.*"),
        turns.unionByName(late.mapInArrow(_apply, _ddl(TURNS))),
    )


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("conv", pa.int64()), ("sha256", pa.string())])
    now, state, conv = None, hashlib.sha256(), None
    for batch in batches:
        for r in batch.to_pylist():
            if now is not None and r["conv"] != conv:
                yield _out([{"conv": conv, "sha256": state.hexdigest()}], out)
                now, state = None, hashlib.sha256()
            conv = r["conv"]
            if r["told"] is not None:
                state.update(("\n" if now else "").encode() + r["told"].encode())
                now = True
            elif now is None:
                now = False
    if now is not None:
        yield _out([{"conv": conv, "sha256": state.hexdigest()}], out)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` of all turns, joined by line feeds. The blocks of a
    conversation are hashed one after the other, so it need not fit into memory."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    told = F.when(F.size("turns") > 0, F.array_join(line, "\n"))
    return (
        turns.select("conv", "part", "block", told.alias("told"))
        .repartition("conv")
        .sortWithinPartitions("conv", "part", "block")
        .mapInArrow(_hash, "conv bigint, sha256 string")
    )
