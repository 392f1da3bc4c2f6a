"""Conversation structure repair by Knuth's lightest derivation.

A conversation is sound if its roles read system?, then user and assistant in turn: ``(s?(ua)+)?`` in initials. Edits
are Keep, Rerole (to user or assistant), Delete and Insert (an empty user or assistant row). An item says "the rows up
to here can be turned into a beginning that leaves the pattern in this state"; every edit is a weighted deduction from
one item to the next. The agenda pops items by (cost, rows read, edits), which every deduction raises and none turns
round, so an item is final when it is popped, and the goal item's edits are the cheapest, ties by their initials.

On Spark, only what the agenda needs (role initial, fault) is sorted by conversation and turn over all partitions. A
conversation inside a partition is derived at once. One that is cut by a partition's end, or is longer than PIECE rows,
is derived piece by piece, from every state to every state; the pieces' items are joined by further deductions, which
is exact because two ways through a piece with one cost are never each other's beginning. Texts move once, at the end.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragframe.llm.common import written

REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
PIECE = 512
# Derivations of this many different conversations (as symbols) are remembered by a worker.
REMEMBERED = 100_000
SPACE = r"[\x20\x09-\x0D]"

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
FINAL = (START, ASSISTANT)
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}
Way = tuple[int, str]


# ---- derivations --------------------------------------------------------------------------------


def deductions(symbols: str, at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(rows read, state, cost, edit) of every edit that can follow an item.

    A row is a symbol: its role's initial (``o`` for others), upper case if its text is truncated, ``x`` if it has to go.
    """
    yield at, _NEXT[state], INSERT_COST, "I"
    if at == len(symbols):
        return
    symbol = symbols[at]
    yield at + 1, state, DELETE_COST, "D"
    if symbol == "x":
        return
    extra = TRUNCATED_COST * symbol.isupper()
    after = _KEEPS.get(symbol.lower(), {}).get(state)
    if after is not None:
        yield at + 1, after, extra, "K"
    yield at + 1, _NEXT[state], REROLE_COST + extra, "R"


def agenda(symbols: str, start: int) -> Iterator[tuple[int, int, Way]]:
    """Items (rows read, state) with their lightest derivation, in the order in which they become final."""
    heap, final = [(0, 0, "", start)], set()
    while heap:
        cost, at, edits, state = heapq.heappop(heap)
        if (at, state) in final:
            continue
        final.add((at, state))
        yield at, state, (cost, edits)
        for after, to, price, edit in deductions(symbols, at, state):
            if (after, to) not in final:
                heapq.heappush(heap, (cost + price, after, edits + edit, to))


@lru_cache(REMEMBERED)
def lightest(symbols: str) -> Way:
    """Cost and edits of the cheapest repair of a whole conversation."""
    return next(way for at, state, way in agenda(symbols, START) if at == len(symbols) and state in FINAL)


def ways(symbols: str, start: int) -> list[Way | None]:
    """The lightest way from ``start`` through all of ``symbols``, by the state at its end."""
    out: list[Way | None] = [None] * STATES
    for at, state, way in agenda(symbols, start):
        if at == len(symbols):
            out[state] = way
            if None not in out[1:] and (start != START or out[START] is not None):
                break
    return out


def joined(left: list[Way | None], piece: list[list[Way | None]]) -> list[Way | None]:
    """Ways through a beginning and the piece after it."""
    out: list[Way | None] = [None] * STATES
    for before, through in zip(left, piece, strict=True):
        for state, way in enumerate(through):
            if before is not None and way is not None:
                both = (before[0] + way[0], before[1] + way[1])
                if out[state] is None or both < out[state]:
                    out[state] = both
    return out


class Facts:
    """Counts over consecutive rows of a conversation, in order of turn; they add up over pieces."""

    FIELDS = "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"

    def __init__(self, *values):
        self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns = values or (
            0, 0, 0, 0, None, None, None, None, 0
        )

    def add(self, other: Facts) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        if other.low is not None:
            self.turns -= self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]


FACTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _report(facts: Facts, way: Way) -> list:
    return [facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, *way]


# ---- rows ---------------------------------------------------------------------------------------


def _clean(rows: DataFrame, conversation: str) -> DataFrame:
    """(conv, turn, role, text, digest): rows with nulls of role and text as one space."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        F.col(f"`{conversation}`").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        F.unhex(F.md5(text)).alias("digest"),
    )


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _faulted(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, n, again, blank, truncated): equal rows of one turn once, with their number."""
    facts = rows.select(
        "conv", "turn", "role", "digest", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?]" + SPACE + r"*\z")).alias("truncated"),
    )
    equal = facts.groupBy("conv", "turn", "role", "digest").agg(
        F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = equal.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("at"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return equal.join(firsts, same).select(
        "conv", "turn", "role", "digest", "n", (~place.eqNullSafe(F.col("at"))).alias("again"), "blank", "truncated"
    )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, turn, symbol, facts) per row, in order."""
    for batch in batches:
        for conv, turn, role, n, again, blank, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            for copy in range(n):
                repeated = not blank and (again or copy > 0)
                cut = truncated and not blank and not repeated
                symbol = "x" if blank or repeated else initial.upper() if cut else initial
                yield conv, symbol, Facts(int(blank), int(repeated), int(cut), 0, initial, initial, turn, turn, int(turn is not None))


def _pieces(batches: Iterator[pa.RecordBatch], kind: pa.DataType, piece: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> pieces: whole conversations with their repair, parts of others with all their ways."""
    place = TaskContext.get().partitionId() << 32
    names = ["conv", "place", *Facts.FIELDS, "cost", "audit", "costs", "audits"]
    kinds = [kind, pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def close(conv, symbols: list[str], facts: Facts, whole: bool) -> None:
        text = "".join(symbols)
        if whole:
            tail = [*lightest(text), None, None]
        else:
            through = [w for start in range(STATES) for w in ways(text, start)]
            tail = [None, None, [w and w[0] for w in through], [w and w[1] for w in through]]
        out.append([conv, place + close.number, *facts.values(), *tail])
        close.number += 1

    close.number = 0
    current, symbols, facts, open_ = None, [], Facts(), True
    for conv, symbol, row in _units(batches):
        if symbols and (conv != current or len(symbols) >= piece):
            ends = conv != current
            close(current, symbols, facts, whole=ends and not open_)
            open_ = not ends  # what follows a cut is a part, what follows an end is not
            symbols, facts = [], Facts()
            if len(out) >= 4096:
                yield flush()
        current = conv
        symbols.append(symbol)
        facts.add(row)
    if symbols:  # the next partition may go on with it
        close(current, symbols, facts, whole=False)
    if out:
        yield flush()


def _folded(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation and place -> one report each."""
    names = ["conv", *(f.split()[0] for f in REPORT.split(", "))]
    kinds = [kind, *[pa.int64()] * 6, pa.string()]

    def row(conv, facts: Facts, now: list[Way | None]) -> pa.RecordBatch:
        values = [conv, *_report(facts, min(now[s] for s in FINAL if now[s] is not None))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    current, facts, now = None, None, None
    for batch in batches:
        for conv, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if facts is None or conv != current:
                if facts is not None:
                    yield row(current, facts, now)
                current, facts, now = conv, Facts(), [(0, ""), None, None, None]
            *counts, costs, audits = values
            facts.add(Facts(*counts))
            flat = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
            now = joined(now, [flat[i : i + STATES] for i in range(0, STATES * STATES, STATES)])
    if facts is not None:
        yield row(current, facts, now)


def reports(rows: DataFrame, conversation: str = "conv_id", piece: int = PIECE) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``rows``.

    Rows count in order of turn, null turns first; rows of one turn by role, then by a hash of the text. Nulls of role
    and text are one space, a null conversation is one of its own. A row's first fault counts: blank, duplicate (role
    and text seen earlier), truncated. ``gaps`` are turns missing between the least and the greatest. A role without an
    initial, like any that is not of the pattern, can only be changed or deleted. No rows give no reports.
    """
    return _reports(_clean(rows, conversation), piece)


def _reports(clean: DataFrame, piece: int) -> DataFrame:
    kind = clean.schema["conv"].dataType.simpleString()
    arrow = to_arrow_type(clean.schema["conv"].dataType)
    faulted = written(_faulted(clean), "faulted")
    ordered = faulted.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    fields = f"conv {kind}, place bigint, {FACTS}, cost bigint, audit string, costs array<bigint>, audits array<string>"
    pieces = ordered.select("conv", "turn", "role", "n", "again", "blank", "truncated").mapInArrow(lambda it: _pieces(it, arrow, piece), fields)
    pieces = written(pieces, "pieces")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps")
    whole = pieces.filter("audit is not null").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = pieces.filter("audit is null").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "place")
    parts = parts.select("conv", *Facts.FIELDS, "costs", "audits").mapInArrow(lambda it: _folded(it, arrow), f"conv {kind}, {REPORT}")
    return whole.unionByName(parts)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, list | None, list[tuple[str, str]]]]:
    """Report row, then text rows, of each conversation in order -> (conv, report values, lines) as they come.

    The report values stand with a conversation's first item only.
    """
    edits, at, expected = "", 0, "user"
    conv = None
    for batch in batches:
        for current, kind, role, text, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines: list[tuple[str, str]] = []
            if kind == 0:
                conv, edits, at, expected = current, values[-1], 0, "user"
            else:
                edit = edits[at]
                at += 1
                if edit == "R":
                    lines.append((expected, text))
                elif edit == "K":
                    lines.append((role, text))
                if lines:
                    expected = "assistant" if lines[0][0][:1] == "u" else "user"
            while at < len(edits) and edits[at] == "I":
                lines.append((expected, ""))
                expected = "assistant" if expected == "user" else "user"
                at += 1
            yield conv, values if kind == 0 else None, lines


def _stream(rows: DataFrame, conversation: str, piece: int) -> tuple[DataFrame, str]:
    """Report rows (kind 0) and text rows (kind 1) of each conversation side by side, in order."""
    clean = _clean(rows, conversation)
    found = written(_reports(clean, piece), "reports")
    names = [f.split()[0] for f in REPORT.split(", ")]
    none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in REPORT.split(", ")]
    heads = found.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), *names,
    )
    both = heads.unionByName(clean.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "digest", *none))
    order = _order()
    ordered = both.repartition("conv").sortWithinPartitions(order[0], "kind", *order[1:])
    return ordered.select("conv", "kind", "role", "text", *names), clean.schema["conv"].dataType.simpleString()


def repaired(rows: DataFrame, conversation: str = "conv_id", piece: int = PIECE) -> DataFrame:
    """(conv, position, role, text): the rows of every repaired conversation, positions from 0.

    A conversation streams through one task in order; no task holds one.
    """
    stream, kind = _stream(rows, conversation, piece)
    arrow = to_arrow_type(stream.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (arrow, pa.int64(), pa.string(), pa.string()), strict=True)],
                names=["conv", "position", "role", "text"],
            )

        for conv, head, lines in _applied(batches):
            position = 0 if head is not None else position
            for role, text in lines:
                out.append((conv, position, role, text))
                position += 1
            if len(out) >= 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return stream.mapInArrow(run, f"conv {kind}, position bigint, role string, text string")


def repair_digests(rows: DataFrame, conversation: str = "conv_id", piece: int = PIECE) -> DataFrame:
    """``reports`` with ``repaired_sha256``, of the repaired rows as ``role:text`` lines."""
    stream, kind = _stream(rows, conversation, piece)
    arrow = to_arrow_type(stream.schema["conv"].dataType)
    names = ["conv", *(f.split()[0] for f in REPORT.split(", ")), "repaired_sha256"]
    kinds = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_row, digest, first = [], None, None, True
        for conv, head, lines in _applied(batches):
            if head is not None:
                if open_row is not None:
                    out.append([*open_row, digest.hexdigest()])
                open_row, digest, first = [conv, *head], hashlib.sha256(), True
            for role, text in lines:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if open_row is not None:
            out.append([*open_row, digest.hexdigest()])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return stream.mapInArrow(run, f"conv {kind}, {REPORT}, repaired_sha256 string")
