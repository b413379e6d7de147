"""Operator 13: conversation structure repair by a rank-compressed dynamic program.

A repaired conversation has roles by the pattern ``(s?(ua)+)?`` of their
initials: a system turn at most at the head, then user and assistant in turns.
Edits keep a turn (0), give it the role user or assistant (2), delete it (3; a
must for blank turns and repeats) or insert an empty user or assistant turn (2);
a truncated turn that stays adds 1.  Of the cheapest edits the ones whose
initials are least in ASCII order count.

Per turn the program takes one macro edit: a run of insertions and what becomes
of the turn, written as a code word such as ``IK``.  No code word begins another,
so of two audit strings of as many words the order is that of their first
different words; a word's place among all words and the rank of its parent among
the states of the layer before therefore stand for the whole string.  A layer is
a cost and a rank for each of four states, with one byte a state for parent and
word; the audit string is read off these bytes at the end.  Each state also
carries the digest of its repaired text so far, so that texts are read once and
never held.

Turns are shuffled once, by conversation, and sorted by turn (nulls first), then
role and text, which settles ties; a window over the same partitions finds
repeats.  Sorting spills, and a task holds one turn's text and eight bytes a turn
of the conversation it is in.  The turns of one conversation are read in order
by one task, since a digest of its whole text can't be made otherwise.

Null roles and texts count as one space, which is a blank text and a role that
fits nowhere; so does an empty role.  A null conversation is one of its own; turns
of null are first and count for no gap.  Repeated rows are repeats.  An empty
table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import column, mapped, of_rows

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Of what came before: nothing, a system turn alone, a user turn last, an assistant turn last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Insertions that complete what each state has left open.
TAIL = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"


class Step(NamedTuple):
    """One macro edit from a state to another; role is None where the turn keeps its own."""

    state: int
    to: int
    cost: int
    code: int
    before: bytes
    edit: str
    role: bytes | None


def _next(state: int) -> tuple[int, bytes]:
    """The state after a user or assistant turn, and which of them fits."""
    return (ASSISTANT, b"assistant") if state == USER else (USER, b"user")


@cache
def steps(initial: str, must_go: bool, truncated: bool) -> tuple[Step, ...]:
    """The macro edits that a turn allows; between two states only the best."""
    best: dict[tuple[int, int], Step] = {}
    for start in (EMPTY, SYSTEM, USER, ASSISTANT):
        state, before = start, b""
        for k in range(3):
            to, role = _next(state)
            break_ = b"" if state == EMPTY else b"\n"
            found = [Step(start, state, INSERT * k + DELETE, CODES.index("I" * k + "D"), before, "D", None)]
            if not must_go:
                found.append(Step(start, to, INSERT * k + REROLE + truncated, CODES.index("I" * k + "R"), before + break_, "R", role))
                kept = SYSTEM if initial == "s" and state == EMPTY else to if initial == role.decode()[0] else None
                if kept is not None:
                    found.append(Step(start, kept, INSERT * k + KEEP + truncated, CODES.index("I" * k + "K"), before + break_, "K", None))
            for step in found:
                key = (step.state, step.to)
                if key not in best or (step.cost, step.code) < (best[key].cost, best[key].code):
                    best[key] = step
            state, before = to, before + break_ + role + b":"
    return tuple(best.values())


class Repair:
    """The dynamic program over one conversation's turns."""

    def __init__(self) -> None:
        self.costs: list[int | None] = [0, None, None, None]
        self.ranks = [0, 0, 0, 0]
        self.digests = [hashlib.sha256(), None, None, None]
        self.parents = bytearray()

    def turn(self, role: str, text: bytes, must_go: bool, truncated: bool) -> None:
        best: list[tuple | None] = [None] * 4
        for step in steps(role[:1], must_go, truncated):
            cost = self.costs[step.state]
            if cost is not None:
                key = (cost + step.cost, self.ranks[step.state], step.code)
                if best[step.to] is None or key < best[step.to][0]:
                    best[step.to] = key, step
        rank = {string: i for i, string in enumerate(sorted({b[0][1:] for b in best if b}))}
        digests: list = [None] * 4
        for to, b in enumerate(best):
            if b is None:
                self.costs[to] = None
                self.parents.append(0)
                continue
            (cost, parent, code), step = b
            digest = self.digests[step.state].copy()
            digest.update(step.before)
            if step.edit != "D":
                digest.update(role.encode() if step.role is None else step.role)
                digest.update(b":")
                digest.update(text)
            digests[to] = digest
            self.parents.append(step.state << 4 | code)
            # Ranks of the layer before are still read by the states to come.
            best[to] = cost, rank[parent, code]
        self.digests = digests
        self.costs, self.ranks = [b and b[0] for b in best], [b[1] if b else 0 for b in best]

    def result(self) -> tuple[int, str, str]:
        """Cost, audit string, SHA-256 of the repaired text."""
        cost, _, tail, state = min((c + INSERT * TAIL[q], self.ranks[q], TAIL[q], q) for q, c in enumerate(self.costs) if c is not None)
        digest, at = self.digests[state].copy(), state
        for _ in range(tail):
            to, role = _next(at)
            digest.update(b"\n" + role + b":")
            at = to
        words = ["I" * tail]
        for layer in range(len(self.parents) - 4, -1, -4):
            entry = self.parents[layer + state]
            words.append(CODES[entry & 15])
            state = entry >> 4
        return cost, "".join(reversed(words)), digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: some turns dropped (gone), emptied, unpunctuated, repeated or given to the user, by their key's CRC."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = of_rows(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat("n", F.col("n")))).drop("col")


def _faults(turns: DataFrame) -> DataFrame:
    """turns with blank, again and truncated (each only where none before it holds), in order within their conversation."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = of_rows(turns.withColumn("gone", gone), "conv_id", "turn", "role", "text", "gone").select("conv_id", "turn", spaced("role"), spaced("text"), "gone")
    bare: Column = F.rtrim("text", F.lit(_SPACE))
    rows = rows.repartition("conv_id").withColumns({"blank": bare == "", "open": ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    # The same partitions serve: conversations are whole in them.
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("again", ~F.col("blank") & (F.row_number().over(same) > 1))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("again") & F.col("open"))
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), "gone", "blank", "again", "truncated")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is counted of one conversation, beside its repair."""

    def __init__(self, key: int | None) -> None:
        self.key, self.repair = key, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: bytes, gone: bool, blank: bool, again: bool, truncated: bool) -> None:
        if gone:
            return
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + truncated
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.repair.turn(role, text, blank or again, truncated)

    def row(self) -> tuple:
        cost, audit, digest = self.repair.result()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    names, out, size = ("turn", "role", "text", "gone", "blank", "again", "truncated"), [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 7, pa.string(), pa.string()], strict=True)], SUMMARY.names)

    for batch in batches:
        columns = [column(batch, n).to_pylist() for n in names]
        for key, *turn in zip(column(batch, "conv_id").to_pylist(), *columns, strict=True):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.row())
                    size += 200 + len(out[-1][7])
                    if size > 1 << 20:
                        yield packed()
                        out, size = [], 0
                now = _Conversation(key)
            now.add(*turn)
    if now is not None:
        out.append(now.row())
        yield packed()


SUMMARY = StructType([StructField(n, LongType()) for n in ("conv_id", *COUNTS)] + [StructField("audit", StringType()), StructField("repaired_sha256", StringType())])


def summaries(turns: DataFrame) -> DataFrame:
    """One row a conversation: its gaps, faults, illegal neighbours, and the cheapest repair's cost, audit string and digest.

    turns: conv_id, turn, role, text and, if there, gone: a turn that is no more,
    though its conversation is to be listed.
    """
    return mapped(_faults(turns), _run, SUMMARY)


_EDITS = StructType([StructField("conv_id", LongType()), StructField("position", LongType()), StructField("edit", StringType()), StructField("number", LongType()), StructField("fits", StringType())])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edit of an audit string: its place in the result (null: deleted), and the number of the turn it is about."""
    for batch in batches:
        for key, audit in zip(column(batch, "conv_id").to_pylist(), column(batch, "audit").to_pylist(), strict=True):
            position = number = 0
            size = len(audit) - audit.count("D")
            for start in range(0, len(audit), 10_000):
                rows = []
                for edit in audit[start : start + 10_000]:
                    number += edit != "I"
                    position += edit != "D"
                    # The last is the assistant's, and those before it alternate.
                    fits = ("user", "assistant")[(position + size) % 2 == 0]
                    rows.append((key, position if edit != "D" else None, edit, number if edit != "I" else None, fits))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], _EDITS.names)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the turns of the repaired conversations, position from 1."""
    edits = mapped(summaries(turns).select("conv_id", "audit"), _spelled, _EDITS).where("position is not null")
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = _faults(turns).where(~F.col("gone")).withColumn("number", F.row_number().over(own).cast("long")).select(F.col("conv_id").alias("c"), "number", "role", F.col("text").cast("string").alias("text"))
    found = edits.join(rows.withColumnRenamed("number", "n"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("number") == F.col("n")), "left")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("fits"))
    return found.select("conv_id", "position", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
