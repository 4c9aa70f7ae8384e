"""Repair of the order of turns by branch and bound, in segments whose results compose.

A conversation is a sequence of turns with a role and at most one fault. Keeping,
changing a role, deleting and inserting turns has a price; what is sought is the
cheapest way to role initials of the form (s?(ua)+)?, of those that cost the same the
one whose letters are least. A sequence is cut into segments of at most SEGMENT turns; a
search gives, for each state before a segment, the best way to each state after it. Two
neighbours compose to one such table, so any number of tasks can share a conversation.

Ways of one segment between the same states have no proper prefix of the same cost
among them, as another letter is an insertion and costs: the least of a whole
sequence is therefore made of the least of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vidlake.llm.storage import save, shuffle_partitions

#: Prices of edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. What may follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
DONE = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: Turns that are searched at once.
SEGMENT = 24
#: Turns that tie are told apart by so much of their texts, and then by the texts' digests.
HEAD = 64
#: White space of the texts.
SPACE = " \t\n\x0b\x0c\r"

#: A turn as the search sees it: its role's initial, and x where it has to go, t where it is truncated, else a dot.
Turn = tuple[str, str]
#: The best way from each state to each: (cost, letters).
Ways = dict[tuple[int, int], tuple[int, str]]


@lru_cache(maxsize=20_000)
def search(turns: tuple[Turn, ...], first: int) -> dict[int, tuple[int, str]]:
    """The cheapest, then least, letters from state `first` to each state, by depth-first branch and bound.

    A stack holds open prefixes. A prefix is given up where its cost and the least that
    the turns after it must cost, or its letters at that cost, are beyond the incumbents
    of all states it can still come to, or where its node (turn and state) has been
    reached at no higher (cost, letters). What stays when the stack is empty is proved
    best.
    """
    n = len(turns)
    ends = {SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
    ends[START] = (START, *(ends[SYSTEM] if any(t == "s" and fault != "x" for t, fault in turns) else ends[USER]))
    least = [0] * (n + 1)  # what must be paid from each turn on, whatever the roles
    for k in range(n - 1, -1, -1):
        least[k] = least[k + 1] + (0 if turns[k][1] == "." else min(DELETE, TRUNCATED) if turns[k][1] == "t" else DELETE)
    best: dict[int, tuple[int, str]] = {}  # the incumbents, by their last state
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, first, 0, "")]
    while stack:
        k, state, cost, letters = stack.pop()
        if (k, state) in seen and seen[k, state] <= (cost, letters):
            continue
        if all(e in best and (cost + least[k], letters) > (best[e][0], best[e][1][: len(letters)]) for e in ends[state]):
            continue
        seen[k, state] = cost, letters
        if k == n:
            best[state] = cost, letters
        after = FOLLOWS[state]
        # the last pushed is tried first: the cheapest edit
        for initial in ROLES:
            if initial in after:
                stack.append((k, after[initial], cost + INSERT, letters + "I"))
        if k == n:
            continue
        initial, fault = turns[k]
        stack.append((k + 1, state, cost + DELETE, letters + "D"))
        if fault == "x":
            continue
        stays = cost + (TRUNCATED if fault == "t" else 0)
        for other in ROLES:
            if other in after and other != initial:
                stack.append((k + 1, after[other], stays + REROLE, letters + "R"))
        if initial in after:
            stack.append((k + 1, after[initial], stays + KEEP, letters + "K"))
    return best


def _joined(a: Ways, b: Ways) -> Ways:
    """The ways through both."""
    out: Ways = {}
    for (p, q), (cost, letters) in a.items():
        for (r, s), (more, rest) in b.items():
            if q == r and ((p, s) not in out or cost + more <= out[p, s][0]):
                way = cost + more, letters + rest
                out[p, s] = min(way, out.get((p, s), way))
    return out


def composed(parts: list[Ways]) -> Ways:
    """The ways through all, joined by twos: letters are copied once a level."""
    while len(parts) > 1:
        parts = [_joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else {(k, k): (0, "") for k in range(4)}


def segment_ways(turns: list[Turn], states: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)) -> Ways:
    return {(p, q): way for p in states for q, way in search(tuple(turns), p).items()}


def _edited(state: int, letter: str, role: str) -> tuple[int, str | None]:
    """The state after an edit, and the role that the turn then has; none where it goes."""
    if letter == "D":
        return state, None
    if letter == "K":
        return FOLLOWS[state][role[:1]], role
    initial = next(c for c in ROLES if c in FOLLOWS[state])
    return FOLLOWS[state][initial], ROLES[initial]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) after the set damage; n: 2 where a row comes twice. Nulls of role and text become one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("d"),
    ).where("d <> 0")
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 3, 2).otherwise(1).alias("n"))


def _place() -> list[Column]:
    """Columns whose order is that of turns (nulls first), and of role and text where turns tie."""
    return [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, HEAD).alias("head"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")]


_ORDER = ["conv_id", "turn", "role", "head", "digest"]


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, head, digest, n, fault, again) without their texts.

    n: how many are alike. fault: blank, truncated or neither of the text itself;
    again: the conversation has had role and text on an earlier turn. Alike rows are
    added up before they are shuffled, so a text that a third of all rows have is one
    row a task.
    """
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    own = rows.select(*_place(), fault.alias("fault"), "n").groupBy(*_ORDER, "fault").agg(F.sum("n").alias("n"))
    said = ["conv_id", "role", "digest"]
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = own.groupBy(*said).agg(F.min(order).alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g"), "first")
    met = own.join(first.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("g")))
    return met.select(*_ORDER, "n", "fault", (order != F.col("first")).alias("again"))


_RUN = "conv_id long, part int, run long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, ps array<int>, qs array<int>, costs array<long>, letters array<string>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
LEGAL = ("su", "ua", "au")


class _Run:
    """The turns of one conversation that lie in one task, as they pass."""

    def __init__(self, conv: int | None, number: int):
        self.conv, self.number, self.counts = conv, number, dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.first = self.last = None
        self.parts: list[Ways] = []
        self.open: list[Turn] = []

    def see(self, turn: int | None, role: str, n: int, fault: str, again: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.first, self.last = (initial if self.first is None else self.first), initial
        more = n if fault == "blank" or again else n - 1  # how many of them have to go
        self.counts["blank" if fault == "blank" else "duplicate"] += more
        if more < n:
            self.counts["truncated"] += fault == "truncated"
            self.open.append((initial, "t" if fault == "truncated" else "."))
            self.close(SEGMENT)
        if more > SEGMENT:
            self.close(1)
            self.parts.append({(k, k): (DELETE * more, "D" * more) for k in range(4)})
        else:
            for _ in range(more):
                self.open.append(("", "x"))
                self.close(SEGMENT)

    def close(self, size: int) -> None:
        """The open turns are a segment once they are so many."""
        if len(self.open) >= size:
            self.parts.append(segment_ways(self.open))
            self.open = []

    def row(self, part: int) -> tuple:
        self.close(1)
        ways = composed(self.parts)
        flat = [p for p, _ in ways], [q for _, q in ways], [c for c, _ in ways.values()], [w for _, w in ways.values()]
        return (self.conv, part, self.number, *self.counts.values(), self.low, self.high, self.first, self.last, *flat)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of the task's sorted turns."""
    part, run, out, number = TaskContext.get().partitionId(), None, [], 0
    kind = _arrow(_RUN)
    for batch in batches:
        for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault", "again"))):
            if run is None or conv != run.conv:
                if run is not None:
                    out.append(run.row(part))
                number += 1
                run = _Run(conv, number)
            run.see(*turn)
            if len(out) >= 5000:
                yield _batch(out, kind)
                out = []
    if run is not None:
        out.append(run.row(part))
    yield _batch(out, kind)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _arrow(schema: str) -> pa.Schema:
    """Of columns of plain kinds and of arrays of these."""
    named = [c.split(" ") for c in schema.split(", ")]
    return pa.schema([(name, pa.list_(_KINDS[kind[6:-1]]) if kind.startswith("array") else _KINDS[kind]) for name, kind in named])


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


_VERDICT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its runs in order of their tasks; the first has no turns."""
    kind, out, runs = _arrow(_VERDICT), [], []

    def judged() -> tuple:
        counts = {c: sum(r[c] or 0 for r in runs) for c in _COUNTS}
        own = [r for r in runs if r["first"] is not None]
        for a, b in zip(own, own[1:]):
            counts["illegal"] += a["last"] + b["first"] not in LEGAL
        known = [r for r in own if r["low"] is not None]
        twice = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))  # a turn number on both sides of a cut
        gaps = known[-1]["high"] - known[0]["low"] + 1 - (counts["turns"] - twice) if known else 0
        ways = composed([dict(zip(zip(r["ps"], r["qs"]), zip(r["costs"], r["letters"]))) for r in own])
        cost, audit = min(ways[START, q] for q in DONE if (START, q) in ways)
        return (runs[0]["conv_id"], gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit)

    for batch in batches:
        for run in batch.to_pylist():
            if runs and run["conv_id"] != runs[0]["conv_id"]:
                out.append(judged())
                runs = []
            runs.append(run)
        yield _batch(out, kind)
        out = []
    yield _batch([judged()] if runs else [], kind)


def verdicts(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conv_id of conversations; rows: its turns (conv_id, turn, role, text, n)."""
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    faults = save(with_faults(rows), "faults")
    # a conversation of any length is cut at its turns, so no task gets more of it than its share
    sorted_rows = faults.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    runs = save(sorted_rows.mapInArrow(_runs, _RUN), "runs")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("part", F.lit(-1))
    every = runs.unionByName(ids, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return every.mapInArrow(_verdicts, _VERDICT)


def _walk(schema: str, with_turns: bool):
    """A task's function over rows sorted by conversation, its verdict first: follows the audit along the turns.

    The letters alone tell each turn's fate: what may follow is settled by the turns
    that stay. Turns are hashed or handed on as they pass, so none are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = _arrow(schema), []
        own, letters, at, state, place, digest = None, "", 0, START, 0, None

        def say(role: str, text: str) -> None:
            nonlocal place
            if with_turns:
                out.append((own[0], place, role, text))
            else:
                digest.update((("\n" if place else "") + f"{role}:{text}").encode())
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                state, role = _edited(state, "I", "")
                at += 1
                say(role, "")

        def close() -> None:
            inserted()
            if not with_turns:
                out.append((*own, digest.hexdigest()))

        names = _VERDICT_COLUMNS
        for batch in batches:
            verdict = list(zip(*(batch.column(c).to_pylist() for c in names)))
            for k, (rank, role, text, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rank", "role", "text", "n")))):
                if rank == 0:
                    if own is not None:
                        close()
                    own, letters, at, state, place, digest = verdict[k], verdict[k][-1], 0, START, 0, hashlib.sha256()
                    continue
                for _ in range(n):
                    inserted()
                    state, left = _edited(state, letters[at], role)
                    at += 1
                    if left is not None:
                        say(left, text)
            yield _batch(out, kind)
            out.clear()
        if own is not None:
            close()
        yield _batch(out, kind)

    return run


_VERDICT_COLUMNS = [c.split()[0] for c in _VERDICT.split(", ")]


def _followed(conversations: DataFrame, rows: DataFrame, schema: str, with_turns: bool) -> DataFrame:
    found = verdicts(conversations, rows).withColumn("rank", F.lit(0))
    turns = rows.select(*_place(), "text", "n").withColumn("rank", F.lit(1))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "rank", *_ORDER[1:])]
    both = turns.unionByName(found, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)
    return both.select(*_VERDICT_COLUMNS, "rank", "role", "text", "n").mapInArrow(_walk(schema, with_turns), schema)


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) as they are; nulls of role and text become one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *named, F.lit(1).alias("n"))


def repaired_turns(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, role, text): the turns that stay after the cheapest repair, counted from 0; inserted ones have an empty text."""
    return _followed(conversations, _turns(conversations) if rows is None else rows, "conv_id long, place long, role string, text string", True)


def repair_report(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of conversations.

    rows (conv_id, turn, role, text, n): the turns to repair, conversations' own if none
    are given. Turns are in order of turn, null first; where that ties, of role and
    text, so repeated rows are neighbours and all but one are duplicates. A null
    conv_id is a conversation of its own; a null role or text is one space; a role
    without letters has no initial and has to be changed or deleted. A conversation
    without turns has zeros, no audit, and the hash of nothing. An empty table gives no
    rows. Columns other than conv_id, turn, role and text are not looked at. Texts are
    shuffled once, and hashed as they pass; the letters of one conversation are one
    string, as the result asks for.
    """
    return _followed(conversations, _turns(conversations) if rows is None else rows, _VERDICT + ", repaired_sha256 string", False)
