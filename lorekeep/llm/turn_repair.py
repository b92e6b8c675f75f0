"""Repair of conversation structure: the cheapest edits that make the roles an optional system turn and pairs of user and assistant turns.

Every row is kept (0), given the role that its place needs (1) or deleted (2), and empty user or assistant rows are inserted (5). Blank and repeated rows must
go; truncated ones that stay cost 5 more. Role initials then read `(s?(ua)+)?`. The edits are found by iterative deepening A*: a
depth-first search tries edits in ASCII order (D, I, K, R) under a bound on the cost, which rises to the least cost that exceeded it. The lower bound of a
state (row, place in the pattern) starts as what its rows cost at least and, once the state has failed, is what
its edits were proven to exceed; the table of failed states is kept from bound to bound. So the first accepting path is the
cheapest, and the first in ASCII order among equals.

Rows are sorted over range partitions by conversation and turn. A conversation of up to `SEGMENT` rows inside one partition is solved at once. A longer one is
searched segment by segment for every pair of entry and exit places (4 x 4), and one that may reach into other partitions hands on these sixteen
answers: where a segment's edits end with one of its own rows, no answer is the start of another, so costs add up and ties are decided segment by
segment. Only costs and ranks of the partitions' answers are put together per conversation; texts are edited where they lie.

Cases: null roles and texts are one space; null turns come first, rows of one turn are ordered by role, then text; repeated rows are merged with their count
before they are sorted, and all but the first of equal role and text are duplicates; rows with a count of 0 only name their conversation, which without
other rows has no edits; rows without a conversation id are one conversation without an id; an empty table gives no rows; very long texts are only
compared and looked at from their end; the result of a conversation is one row and has to fit one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

SEGMENT = 64
BLANKS = " \t\n\x0b\x0c\r"
#: Places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
NEEDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: What closes a conversation from each place, and the cost.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}

#: One row of a search: initial of its role, whether it has to go, whether it is truncated.
Item = tuple[str, bool, bool]


def search(items: list[Item], entry: int, leave: int | None = None) -> tuple[int, str] | None:
    """(cost, edits) from the place `entry`: to the end of a conversation, or, ending with an item's own edit, to the place `leave`."""
    count = len(items)
    at_least = [0] * (count + 1)
    for i in range(count - 1, -1, -1):
        initial, gone, cut = items[i]
        at_least[i] = at_least[i + 1] + (DELETE if gone or cut else 0 if initial and initial in "sua" else REROLE)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def lower(i: int, place: int) -> int:
        found = failed.get((i, place))
        if found is not None:
            return found
        if leave is None:
            return at_least[i] if i < count else INSERT * len(CLOSING[place])
        if i == count:
            return 0 if place == leave else NEVER
        return NEVER if leave < USER and place > leave else at_least[i]

    def edits(i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
        if i < count:
            initial, gone, cut = items[i]
            yield "D", DELETE, i + 1, place
        yield "I", INSERT, i, NEEDED[place]
        if i < count and not gone:
            kept = KEPT.get((place, initial))
            if kept is not None:
                yield "K", CUT * cut, i + 1, kept
            yield "R", REROLE + CUT * cut, i + 1, NEEDED[place]

    def descend(i: int, place: int, left: int) -> bool:
        if i == count and (place == leave or leave is None and not CLOSING[place]):
            return True
        proven = NEVER
        for letter, cost, j, after in edits(i, place) if i < count or leave is None else ():
            if cost + lower(j, after) <= left and descend(j, after, left - cost):
                path.append(letter)
                return True
            proven = min(proven, cost + lower(j, after))
        failed[i, place] = max(lower(i, place), proven)
        return False

    bound = lower(0, entry)
    while bound < NEVER:
        if descend(0, entry, bound):
            return bound, "".join(reversed(path))
        bound = lower(0, entry)
    return None


class Answers:
    """Cheapest edits of a stretch of rows for every entry and exit place: costs, ranks of the edits among one entry's exits, and edits."""

    def __init__(self, costs, ranks, edits):
        self.costs, self.ranks, self.edits = costs, ranks, edits

    @classmethod
    def of(cls, items: list[Item]) -> Answers:
        costs, ranks, edits = {}, {}, {}
        for p in PLACES:
            found = {q: f for q in PLACES if (f := search(items, p, q))}
            for rank, q in enumerate(sorted(found, key=lambda q: found[q][1])):
                costs[p, q], ranks[p, q], edits[p, q] = found[q][0], rank, (None, found[q][1])
        return cls(costs, ranks, edits)

    def then(self, other: Answers) -> tuple[Answers, dict[tuple[int, int], int]]:
        """The answers of both stretches one after the other, and the place between them for each entry and exit."""
        costs, ranks, edits, between = {}, {}, {}, {}
        for p in PLACES:
            order = {}
            for q in PLACES:
                ways = [(self.costs[p, m] + other.costs[m, q], self.ranks[p, m], m) for m in PLACES if (p, m) in self.costs and (m, q) in other.costs]
                if ways:
                    cost, rank, m = min(ways)
                    costs[p, q], between[p, q], order[q] = cost, m, (rank, other.ranks[m, q])
                    edits[p, q] = (self.edits[p, m], other.edits[m, q]) if self.edits else None
            ranks |= {(p, q): rank for rank, q in enumerate(sorted(order, key=order.get))}
        return Answers(costs, ranks, edits if self.edits else {}), between

    def closed(self) -> tuple[int, int]:
        """(cost, exit place) of a whole conversation."""
        cost, _, q = min((self.costs[START, q] + INSERT * len(CLOSING[q]), self.ranks[START, q], q) for q in PLACES if (START, q) in self.costs)
        return cost, q


def spelled(chain) -> str:
    """The letters of nested pairs of edits."""
    letters, open_ = [], [chain]
    while open_:
        one = open_.pop()
        if isinstance(one, str):
            letters.append(one)
        elif one is not None:
            open_ += [one[0], one[1]]
    return "".join(reversed(letters))


def edited(rows: list[tuple[str, str]], letters: str, place: int = START) -> list[dict]:
    """The rows after the edits."""
    out, rest = [], iter(rows)
    for letter in letters:
        role, text = next(rest) if letter != "I" else ("", "")
        if letter == "K":
            place = KEPT[place, role[:1]]
        elif letter != "D":
            place = NEEDED[place]
            role = ROLE[place]
        if letter != "D":
            out.append({"role": role, "text": text})
    return out


class Run:
    """What one partition holds of one conversation, row by row."""

    def __init__(self, conversation):
        self.conversation = conversation
        self.rows: list[tuple[str, str]] = []
        self.items: list[Item] = []
        self.low = self.high = self.head = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool):
        if turn is not None and copies and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        end = text.rstrip(BLANKS)[-1:]
        for copy in range(copies):
            blank, again = not end, seen or copy > 0
            cut = not blank and not again and end not in ".!?"
            self.blank += blank
            self.duplicate += again and not blank
            self.truncated += cut
            if self.rows:
                self.illegal += self.tail + role[:1] not in LEGAL
            else:
                self.head = role[:1]
            self.tail = role[:1]
            self.rows.append((role, text))
            self.items.append((role[:1], blank or again, cut))

    def figures(self) -> list:
        return [self.conversation, self.blank, self.duplicate, self.truncated, self.illegal]

    def answers(self) -> Answers | None:
        whole = None
        for at in range(0, len(self.items), SEGMENT):
            part = Answers.of(self.items[at:at + SEGMENT])
            whole = whole.then(part)[0] if whole else part
        return whole

    def solved(self) -> tuple[int, str]:
        if len(self.items) <= SEGMENT:
            return search(self.items, START)
        whole = self.answers()
        cost, q = whole.closed()
        return cost, spelled(whole.edits[START, q]) + CLOSING[q]


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def merged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies, seen): equal rows once with their count; `seen` where an earlier turn has the same role and text."""
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32))
    present = rows.where("copies > 0").select(F.col("conv").alias("c"), digest.alias("s"), F.struct("turn").alias("at"))
    firsts = present.groupBy("c", "s").agg(F.min("at").alias("earliest"), F.max("at").alias("latest")).where(~F.col("earliest").eqNullSafe(F.col("latest"))).drop("latest")
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", digest)
    found = once.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    return found.select("conv", "turn", "role", "text", "copies", (F.col("earliest").isNotNull() & ~F.col("earliest.turn").eqNullSafe(F.col("turn"))).alias("seen"))


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """One row per conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    The counts describe the rows as they came, `audit` spells the edits and `repaired` holds (role, text) after them. `copies` names a column
    that says how often a row stands there; a row with 0 only names its conversation.
    """
    given = rows.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    key = given.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "text"]
    ordered = merged(given).repartitionByRange(*order).sortWithinPartitions(*order)

    said = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    done_schema = f"conv {key}, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, repaired array<struct<role:string,text:string>>"
    open_schema = "run long, low long, high long, turns long, head string, tail string, costs array<long>, ranks array<long>, edits array<string>"
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit", "repaired",
             "run", "low", "high", "turns", "head", "tail", "costs", "ranks", "edits"]
    kinds = [pa.int64()] * 6 + [pa.string(), said] + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())]

    def batch_of(found: list[list], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), [kind, *kinds])], names)

    def closed(run: Run) -> list:
        cost, audit = run.solved()
        return [*run.figures(), gaps(run.low, run.high, run.turns), cost, audit, edited(run.rows, audit), *[None] * 9]

    def open_run(run: Run, number: int) -> list:
        whole = run.answers()
        every = [(p, q) for p in PLACES for q in PLACES]
        found = [[-1 if whole is None or e not in whole.costs else f(e) for e in every] for f in (lambda e: whole.costs[e], lambda e: whole.ranks[e])]
        letters = ["" if whole is None or e not in whole.costs else spelled(whole.edits[e]) for e in every]
        return [*run.figures(), None, None, None, [{"role": r, "text": t} for r, t in run.rows], number, run.low, run.high, run.turns, run.head, run.tail, *found, letters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first and the last conversation of a partition may have rows in others.
        now, first, number, found, held, kind = None, True, TaskContext.get().partitionId() << 1, [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for conv, turn_, role_, text_, copies_, seen in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conversation != conv:
                    if now is not None:
                        found.append(open_run(now, number) if first else closed(now))
                        held += sum(len(t) for _, t in now.rows)
                        first = False
                        if held > 1 << 22 or len(found) >= 1000:
                            yield batch_of(found, kind)
                            found, held = [], 0
                    now = Run(conv)
                now.add(turn_, role_, text_, copies_, seen)
        if now is not None:
            found.append(open_run(now, number + 1))
        if found:
            yield batch_of(found, kind)

    parts = cut_lineage(ordered.mapInArrow(run, f"{done_schema}, {open_schema}"))
    results = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    return parts.where("run is null").select(results).union(together(parts.where("run is not null"), key).select(results))


def together(parts: DataFrame, key: str) -> DataFrame:
    """Conversations whose rows lie in several partitions, from the answers of each."""
    figures = ["conv", "run", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "head", "tail", "costs", "ranks"]
    schema = f"conv {key}, run long, entry int, leave int, closing string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        total = {n: int(rows[n].sum()) for n in ("blank", "duplicate", "truncated", "illegal")}
        full = [r for r in rows.itertuples() if r.head is not None and not pd.isna(r.head)]
        total["illegal"] += sum(a.tail + b.head not in LEGAL for a, b in zip(full, full[1:]))
        dated = [r for r in full if not pd.isna(r.low)]
        distinct = sum(int(r.turns) for r in dated) - sum(a.high == b.low for a, b in zip(dated, dated[1:]))
        total["gaps"] = gaps(int(dated[0].low), int(dated[-1].high), distinct) if dated else 0
        whole, between = None, []
        for r in full:
            at = {(i // 4, i % 4): i for i in range(16) if r.costs[i] >= 0}
            part = Answers({e: int(r.costs[i]) for e, i in at.items()}, {e: int(r.ranks[i]) for e, i in at.items()}, {})
            if whole:
                whole, middle = whole.then(part)
                between.append(middle)
            else:
                whole = part
        total["cost"], leave = whole.closed() if whole else (0, START)
        places = [leave]
        for middle in reversed(between):
            places.append(middle[START, places[-1]])
        places = [START, *reversed(places)]
        picks = {r.run: (places[i], places[i + 1], CLOSING[leave] if i == len(full) - 1 else "") for i, r in enumerate(full)}
        out = pd.DataFrame([(r, *picks.get(r, (START, START, ""))) for r in rows["run"].tolist()], columns=["run", "entry", "leave", "closing"])
        out.insert(0, "conv", rows["conv"].tolist())
        return out.assign(**total)[["conv", "run", "entry", "leave", "closing", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]]

    picks = parts.select(figures).groupBy("conv").applyInPandas(join, schema)
    texts = parts.select(F.col("run").alias("of"), "repaired", "edits")
    chosen = picks.join(texts, F.col("run") == F.col("of")).select("conv", "run", "entry", F.concat(F.get("edits", F.col("entry") * 4 + F.col("leave")), "closing").alias("audit"), "repaired",
                                                                   "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                entry, audit, rows = (row.column(i)[0].as_py() for i in (2, 3, 4))
                made = edited([(r["role"], r["text"]) for r in rows], audit, entry)
                columns = list(row.columns)
                columns[4] = pa.array([made], row.column(4).type)
                yield pa.RecordBatch.from_arrays(columns, row.schema.names)

    applied = chosen.mapInArrow(apply, chosen.schema)
    pieces = F.array_sort(F.collect_list(F.struct("run", "audit", "repaired")))
    same = [F.max(n).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return applied.groupBy("conv").agg(pieces.alias("pieces"), *same).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("pieces.audit", "").alias("audit"), F.flatten("pieces.repaired").alias("repaired"))
