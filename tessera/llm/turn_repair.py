"""Cheapest repair of conversations by depth-first branch and bound.

Rows of a conversation are kept, given another role, deleted, or rows are
inserted, so that roles read: a system turn or none, then user and assistant in
turns.  The search goes depth first over an explicit stack of prefixes.  Suffix
lower bounds say what the rows ahead cost at least; a prefix goes when its cost
and bound are worse than the incumbent (cost, audit), or when a table shows a
better prefix at the same node (row, last role).  It ends when the stack is
empty, so the incumbent is proved.

A long conversation is searched in parts of a bounded number of rows: for each
role before a part the cheapest repairs up to each role after it, then the same
search over parts.  The result is the same.

Spark deals rows by conversation and sorts them; each row comes twice, first a
byte that says what it is and then its text, so that a task holds one
conversation's bytes and edits, and never its texts.

Defined cases: a null conversation id is a conversation, a null turn comes
first, null roles and texts count as one space; rows that share a turn go by
role and text; a role that is empty has no initial; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import bounded_batches, parallelism

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3  # costs of the edits
UNFINISHED = 3                             # what a truncated row adds that is not deleted
PART = 16                                  # rows searched at once

#: The last role that stands: none yet, system, user, assistant.  A repair may end in NONE or ASSISTANT.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: b"user", ASSISTANT: b"assistant"}

#: What a row is: the initial of its role, and its fault times four (1 truncated, 2 blank, 3 duplicate).
INITIALS = "sua"  # 0, 1, 2; 3 is any other
TRUNCATED, REMOVED = 4, 8


def edits(row: int, last: int) -> list[tuple[str, int, int]]:
    """(initial, cost, role that then stands last) of what may be done with a row."""
    if row >= REMOVED:
        return [("D", DELETE, last)]
    extra, initial, wanted = UNFINISHED * (row >= TRUNCATED), row & 3, NEXT[last]
    out = [("D", DELETE, last)]
    if initial == 0 and last == NONE:
        out.append(("K", KEEP + extra, SYSTEM))
    if initial == wanted - 1:
        out.append(("K", KEEP + extra, wanted))
    out.append(("R", REROLE + extra, wanted))
    return out


def search(n: int, moves: Callable, bound: list[int], start: int, ends,
           incumbent: tuple[int, str] | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) from (0, start) to (n, one of ends).

    `moves(i, state)` gives (audit, cost, next i, next state); `bound[i]` is at
    most the cost of any way from row i to the end."""
    best = incumbent
    stack = [(0, "", 0, start)]
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    while stack:
        cost, audit, i, state = stack.pop()
        if best is not None and (cost + bound[i] > best[0] or (cost + bound[i] == best[0] and audit > best[1])):
            continue
        known = seen.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        ahead = [(cost + c, audit + a, j, s) for a, c, j, s in moves(i, state)]
        # The most promising last, so that it is taken first.
        ahead.sort(key=lambda x: (x[0] + bound[x[2]], x[1]), reverse=True)
        stack += ahead
    return best


def _bounds(least: list[int]) -> list[int]:
    out = [0] * (len(least) + 1)
    for i in range(len(least) - 1, -1, -1):
        out[i] = out[i + 1] + least[i]
    return out


_LEAST = {row: min(c for last in NEXT for _, c, _ in edits(row, last)) for row in range(16)}


def _row_moves(rows: bytes) -> Callable:
    table = {(row, last): edits(row, last) for row in set(rows) for last in NEXT}

    def moves(i, last):
        out = [(a, c, i + 1, s) for a, c, s in table[rows[i], last]] if i < len(rows) else []
        return [*out, ("I", INSERT, i, NEXT[last])]

    return moves


def _part_moves(parts: list[dict]) -> Callable:
    def moves(i, last):
        return [(a, c, i + 1, b) for (before, b), (c, a) in parts[i].items() if before == last] if i < len(parts) else []

    return moves


def _ways(n: int, moves: Callable, bound: list[int]) -> dict[tuple[int, int], tuple[int, str]]:
    """The least (cost, audit) from each last role before to each after, where there is a way."""
    out = {}
    for before in NEXT:
        for after in NEXT:
            if after in ROLES or before == after or (before, after) == (NONE, SYSTEM):
                way = search(n, moves, bound, before, (after,))
                if way is not None:
                    out[before, after] = way
    return out


@lru_cache(maxsize=1 << 14)
def _row_ways(rows: bytes) -> dict[tuple[int, int], tuple[int, str]]:
    return _ways(len(rows), _row_moves(rows), _bounds([_LEAST[r] for r in rows]))


def _part_bounds(parts: list[dict]) -> list[int]:
    return _bounds([min(c for c, _ in p.values()) for p in parts])


@lru_cache(maxsize=1 << 16)
def _short(rows: bytes) -> tuple[int, str]:
    return search(len(rows), _row_moves(rows), _bounds([_LEAST[r] for r in rows]), NONE, ENDS, (DELETE * len(rows), "D" * len(rows)))


def repair(rows: bytes, part: int = PART) -> tuple[int, str]:
    """The least cost and, of the repairs with it, the audit that is first in ASCII."""
    if len(rows) <= part:
        return _short(rows)
    parts = [_row_ways(rows[i:i + part]) for i in range(0, len(rows), part)]
    while len(parts) > part:
        groups = [parts[i:i + part] for i in range(0, len(parts), part)]
        parts = [_ways(len(g), _part_moves(g), _part_bounds(g)) for g in groups]
    return search(len(parts), _part_moves(parts), _part_bounds(parts), NONE, ENDS)


class Conversation:
    """One conversation as it streams by: its bytes first, then its texts."""

    def __init__(self, conv):
        self.conv, self.rows, self.turns, self.way = conv, bytearray(), [None, None, 0], None

    def add(self, what: int, turn: int | None) -> None:
        self.rows.append(what)
        if turn is not None:
            low, high, distinct = self.turns
            self.turns = [turn if low is None else low, turn, distinct + (turn != high)]

    def _next(self, wanted: bytes | None) -> bytes:
        """Take the edit at hand, and the role that it gives."""
        edit = self.way[1][self.at]
        self.at += 1
        if edit == "K" and self.last == NONE and wanted[:1] == b"s":
            self.last = SYSTEM
        elif edit != "D":
            self.last = NEXT[self.last]
        return wanted if edit == "K" else ROLES.get(self.last)

    def settle(self) -> None:
        if self.way is None:
            self.way, self.at, self.last = repair(bytes(self.rows)), 0, NONE

    def inserted(self):
        """Rows that stand before the next row of the conversation."""
        self.settle()
        while self.at < len(self.way[1]) and self.way[1][self.at] == "I":
            yield self._next(None), b""

    def edited(self, role: bytes, text: bytes):
        yield from self.inserted()
        removed = self.way[1][self.at] == "D"
        role = self._next(role)
        if not removed:
            yield role, text

    def summary(self) -> tuple:
        self.settle()
        low, high, distinct = self.turns
        faults = [sum(r >> 2 == f for r in self.rows) for f in (2, 3, 1)]
        legal = {(0, 1), (1, 2), (2, 1)}
        illegal = sum((a & 3, b & 3) not in legal for a, b in zip(self.rows, self.rows[1:]))
        return self.conv, 0 if low is None else high - low + 1 - distinct, *faults, illegal, *self.way


def _stream(batches, whole):
    """Repaired rows, or with `whole` a summary of each conversation and the hash of its repaired rows."""
    now, digest, place, rows = None, None, 0, []
    kind = None

    def took(pairs):
        nonlocal place
        for role, text in pairs:
            if whole:
                digest.update(b"\n" * (place > 0) + role + b":")
                digest.update(text)
            else:
                rows.append((now.conv, place, role, text))
            place += 1

    def ended():
        took(now.inserted())
        if whole:
            rows.append((*now.summary(), digest.hexdigest()))

    def out():
        columns = list(zip(*rows)) if rows else [[]] * (9 if whole else 4)
        kinds = [kind, *([pa.int64()] * 6 + [pa.string()] * 2 if whole else [pa.int64(), pa.binary(), pa.binary()])]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        rows.clear()
        names = SUMMARY if whole else ("conv", "place", "role", "text")
        return pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        conv, phase, what, turn = (batch.column(i).to_pylist() for i in range(4))
        role, text = (batch.column(i).cast(pa.binary()).to_pylist() for i in (4, 5))
        for i in range(len(conv)):
            if now is None or conv[i] != now.conv:
                if now is not None:
                    ended()
                now, digest, place = Conversation(conv[i]), hashlib.sha256(), 0
            if phase[i]:
                took(now.edited(role[i], text[i]))
            elif what[i] is not None:
                now.add(what[i], turn[i])
        yield out()
    if now is not None:
        ended()
        yield out()


SUMMARY = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_BLANKS = " \t\n\x0b\x0c\r"


def _in_order(turns: DataFrame, stands: Column | None, names: tuple) -> DataFrame:
    """(conv, phase, what, turn, role, text), conversations together, their bytes before their texts."""
    conv, turn, role, text = (F.col(c) for c in names)
    rows = turns.select(conv.alias("conv"), turn.cast("bigint").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                        F.coalesce(text, F.lit(" ")).alias("text"), (F.lit(True) if stands is None else stands).alias("stands"))
    rows = rows.repartition(parallelism(turns.sparkSession), "conv")
    by_turn = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy("conv", "stands", "role", "text").orderBy(by_turn)) > 1
    place = F.row_number().over(Window.partitionBy("conv").orderBy(by_turn, "role", "text"))
    said = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(said == "", 2).when(seen, 3).when(~F.substring(said, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == INITIALS[0], 0).when(initial == INITIALS[1], 1).when(initial == INITIALS[2], 2).otherwise(3)
    rows = rows.withColumn("what", F.when(F.col("stands"), (code + 4 * fault)).cast("int")).withColumn("place", place)
    rows = rows.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1)))).where("phase = 0 or stands")
    late = F.col("phase") == 1
    return rows.sortWithinPartitions("conv", "phase", "place").select(
        "conv", "phase", F.when(~late, F.col("what")).alias("what"), F.when(~late, F.col("turn")).alias("turn"),
        F.when(late, F.col("role")).alias("role"), F.when(late, F.col("text")).alias("text"))


NAMES = ("conv_id", "turn", "role", "text")


def repaired_turns(turns: DataFrame, names: tuple = NAMES, stands: Column | None = None) -> DataFrame:
    """(conversation, place, role, text) of the repaired conversations; only rows that stand count."""
    bounded_batches(turns.sparkSession)
    rows = _in_order(turns, stands, names)
    kind = rows.schema["conv"].dataType.simpleString()
    out = rows.mapInArrow(partial(_stream, whole=False), f"conv {kind}, place bigint, role string, text string")
    return out.withColumnsRenamed({"conv": names[0], "role": names[2], "text": names[3]})


def repair_summary(turns: DataFrame, names: tuple = NAMES, stands: Column | None = None) -> DataFrame:
    """Per conversation, also of those without a row that stands: gaps, faults, cost, audit, hash of the repaired rows."""
    bounded_batches(turns.sparkSession)
    rows = _in_order(turns, stands, names)
    kind = rows.schema["conv"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in SUMMARY[1:7])
    return rows.mapInArrow(partial(_stream, whole=True), f"conv {kind}, {longs}, audit string, repaired_sha256 string").withColumnRenamed(
        "conv", names[0])


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, stands): rows dropped, emptied, left without stops, repeated or said by the
    user, by the checksum of conversation and turn.  Dropped rows do not stand."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                        (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("harm") != 0).alias("stands"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")
