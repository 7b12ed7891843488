"""Chat formatting with minimum-cost role repair.

The automaton of legal turns: an optional system turn, then user and assistant in turn, ending with
the assistant. Dynamic programming finds the cheapest way to make a conversation legal by keeping a
turn, relabelling it, merging it into the turn before it, or inserting empty turns; ties go to the
role listed first and to merging before inserting. The repaired turns are then rendered.

A step of the program is a matrix over the states, so a long conversation is cut into chunks by turn
number: chunks are summed up in matrices, the matrices are chained, and each chunk is then repaired on
its own between its entry and its exit state. No conversation is ever gathered in one task; what meets
in one task is one small matrix for each ``chunk`` turns of it.

Defined cases: rows are ordered by turn (nulls last), role, text; rows that are equal in all three are
all kept; an unknown or null role costs ``unknown`` to label; a null text renders as an empty one; null
conversation ids form one conversation; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_by_value

ship_by_value(__name__)

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn. Legal next roles of each.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = float("inf")


@dataclass(frozen=True)
class ChatConfig:
    merge: float = 1.0
    insert: float = 2.0
    relabel: float = 3.0
    unknown: float = 1.0
    chunk: int = 512
    #: How a turn begins and ends.
    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"


def way(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns to insert before a turn of this role becomes legal; None if it never does."""
    if role in NEXT[state]:
        return ()
    for between in NEXT[state]:
        if between != SYSTEM and role in NEXT[between]:
            return (between,)
    return None


def steps(role: str | None, config: ChatConfig) -> list[list[tuple[float, str, tuple[int, ...]]]]:
    """For each state and each output role (as next state): cost, operation, inserted turns."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    table = []
    for state in range(4):
        row = [(FAR, "", ())]
        for out in (SYSTEM, USER, ASSISTANT):
            label = 0.0 if out == own else config.unknown if own is None else config.relabel
            options = []
            if out == state:
                options.append((label + config.merge, "merge", ()))
            if (between := way(state, out)) is not None:
                options.append((label + config.insert * len(between), "keep", between))
            cost, op, between = min(options, key=lambda x: x[0], default=(FAR, "", ()))
            row.append((cost, op if label == 0 else "relabel" if op == "keep" else "relabel+merge", between))
        table.append(row)
    return table


def closing(state: int, config: ChatConfig) -> tuple[float, tuple[int, ...]]:
    """Cost and turns to insert to end after this state."""
    missing = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
    return config.insert * len(missing), missing


class Tables:
    """Steps by role."""

    def __init__(self, config: ChatConfig) -> None:
        self.config, self.known = config, {r: steps(r, config) for r in (*ROLES, None)}

    def __getitem__(self, role: str | None) -> list[list[tuple[float, str, tuple[int, ...]]]]:
        return self.known.get(role) or self.known[None]


def repair(roles: list[str | None], tables: Tables, entry: int = START, exit_state: int | None = None) -> tuple[float, list[tuple[int, str, tuple[int, ...]]], int]:
    """Cost, (output role, operation, inserted turns) of each turn, and the last state.

    Without an exit state the end is free and its cost includes the closing turns.
    """
    best = [FAR] * 4
    best[entry] = 0.0
    back: list[list[int]] = []
    for role in roles:
        table, new, came = tables[role], [FAR] * 4, [0] * 4
        for out in (SYSTEM, USER, ASSISTANT):
            for state in range(4):
                cost = best[state] + table[state][out][0]
                if cost < new[out]:
                    new[out], came[out] = cost, state
        best = new
        back.append(came)
    if exit_state is None:
        total, state = min((best[s] + closing(s, tables.config)[0], s) for s in range(4))
    else:
        total, state = best[exit_state], exit_state
    last, out = state, []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        before = came[state]
        _, op, between = tables[role][before][state]
        out.append((state, op, between))
        state = before
    return total, out[::-1], last


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns. The rows are sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != key:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row)
    if rows:
        yield key, rows


def _matrix(batches: Iterator[pa.RecordBatch], config: ChatConfig) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, role...) to (conv, chunk, 16 costs from state to state)."""
    tables = Tables(config)
    for (conv, chunk), rows in _groups(batches, 2):
        costs = []
        for entry in range(4):
            best = [FAR] * 4
            best[entry] = 0.0
            for row in rows:
                table = tables[row[2]]
                best = [FAR, *(min(best[s] + table[s][out][0] for s in range(4)) for out in (SYSTEM, USER, ASSISTANT))]
            costs += best
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([chunk], pa.int64()), pa.array([costs], pa.list_(pa.float64()))], names=["conv", "chunk", "costs"])


def _chain(batches: Iterator[pa.RecordBatch], config: ChatConfig) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, costs), sorted, to (conv, chunk, entry, exit) along each conversation's cheapest way."""
    for (conv,), rows in _groups(batches, 1):
        best, back = [0.0, FAR, FAR, FAR], []
        for _, _, costs in rows:
            ways = [min((best[s] + costs[4 * s + out], s) for s in range(4)) for out in range(4)]
            best, came = [w[0] for w in ways], [w[1] for w in ways]
            back.append(came)
        state = min((best[s] + closing(s, config)[0], s) for s in range(4))[1]
        entries, exits = [], []
        for came in reversed(back):
            exits.append(state)
            state = came[state]
            entries.append(state)
        chunks = pa.array([r[1] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([conv] * len(rows), pa.string()), chunks, pa.array(entries[::-1], pa.int32()), pa.array(exits[::-1], pa.int32())], names=["conv", "chunk", "entry", "exit"])


def _render(batches: Iterator[pa.RecordBatch], config: ChatConfig) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, role, turn, text, conv_id, entry, exit, last) to one row for each turn.

    The rendered pieces of a conversation, put together in order, are the whole.
    """
    tables = Tables(config)
    opened = lambda r: config.opening.format(role=ROLES[r - 1])
    names = "conv_id chunk seq turn op role n_inserted cost rendered".split()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
    held: list[tuple] = []
    for (_, chunk), rows in _groups(batches, 2):
        entry, final, last = rows[0][6] or START, rows[0][7], rows[0][8]
        _, done, end = repair([r[2] for r in rows], tables, entry, final)
        state = entry
        for seq, (row, (out, op, between)) in enumerate(zip(rows, done, strict=True)):
            cost = tables[row[2]][state][out][0]
            if "merge" in op:
                piece = "\n" + (row[4] or "")
            else:
                piece = config.closing if state != START else ""
                piece += "".join(opened(r) + config.closing for r in between) + opened(out) + (row[4] or "")
            n = len(between)
            if last and seq == len(rows) - 1:
                more, missing = closing(end, config)
                piece += config.closing + "".join(opened(r) + config.closing for r in missing)
                cost, n = cost + more, n + len(missing)
            held.append((row[5], chunk, seq, row[3], op, ROLES[out - 1], n, cost, piece))
            state = out
        if len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def format_chats(conversations: DataFrame, config: ChatConfig = ChatConfig(), scratch: Scratch | None = None) -> DataFrame:
    """One row for each turn: conv_id, chunk and seq (its order), turn, op, role, n_inserted, cost, rendered."""
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    far: Column = F.lit((1 << 62) // config.chunk)  # null turns come last
    chunk = F.coalesce(F.floor(F.col("turn").cast("long") / F.lit(config.chunk)), far)
    turns = conversations.select(conv.alias("conv"), chunk.cast("long").alias("chunk"), "role", F.col("turn").cast("long").alias("turn"), "text", F.col("conv_id").cast("long").alias("conv_id"))
    long = turns.groupBy("conv").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo < hi")
    long = scratch.keep(long, "long")
    if long.isEmpty():
        states = conversations.sparkSession.createDataFrame([], "conv string, chunk long, entry int, exit int")
    else:
        several = turns.join(long.select("conv"), "conv", "left_semi").select("conv", "chunk", "role", "turn", "text")
        several = several.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", F.col("turn").asc_nulls_last(), "role", "text")
        matrices = several.select("conv", "chunk", "role").mapInArrow(lambda b: _matrix(b, config), "conv string, chunk long, costs array<double>")
        chained = matrices.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(lambda b: _chain(b, config), "conv string, chunk long, entry int, exit int")
        states = scratch.keep(chained, "states")
    placed = turns.join(states, ["conv", "chunk"], "left").join(long.select("conv", "hi"), "conv", "left")
    placed = placed.select("conv", "chunk", "role", "turn", "text", "conv_id", "entry", F.when(F.col("hi") > F.col("chunk"), F.col("exit")).alias("exit"), (F.coalesce("hi", "chunk") == F.col("chunk")).alias("last"))
    placed = placed.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", F.col("turn").asc_nulls_last(), "role", "text")
    schema = "conv_id long, chunk long, seq long, turn long, op string, role string, n_inserted long, cost double, rendered string"
    return placed.mapInArrow(lambda b: _render(b, config), schema)
