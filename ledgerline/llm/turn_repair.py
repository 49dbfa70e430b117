"""Repair of conversation structure by the cheapest edits, walked from a square-root checkpointed table.

A conversation's rows are taken by turn (NULL first; rows of one turn by role and a digest of the text). Each row has at most one
fault, the first of: blank (no character but white space), duplicate (role and text seen earlier), truncated (the last character
other than white space does not end a sentence). The edits are Keep (0), Rerole to user or assistant (2), Delete (3, required for
blank and duplicate rows) and Insert of an empty turn of user or assistant (2); a truncated row that stays adds 1. The roles that
result must read, by their initials, ``(s?(ua)+)?``. Of the cheapest edit sequences the ASCII-least is taken.

Method: a state is what the roles so far allow next (4 states). The cost to the end is computed backward over the rows; only the
vectors at about every square root of n rows are stored, and walking forward each block is computed again from its checkpoint. In a row's
state the first tight edit in ASCII order is emitted, an edit being tight if its cost plus the cost to the end after it is the
least cost. So a task holds a byte a row of one conversation, the checkpoints and one block, never its texts: rows
reach it twice, first as narrow facts (role, faults), then as texts in the same order, which stream through. Which rows are
duplicates is found by row numbers per (conversation, role, text digest), in ranges where such a group is heavy.

The result of :func:`repair_turns` are the repaired turns in order and, last, a report row for each conversation.

Defined cases: a conversation without rows (``also`` names it) has zeros and no edits; a NULL conversation id is an id like any
other; NULL roles and texts are empty; a NULL turn sorts first and counts for no gap. Repeated rows are duplicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.ordered import sequence
from ._frames import bounded_batches
from .turns import decimal_crc, digest

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: nothing yet, after system, after user, after assistant. A new user or assistant turn leads on, a kept one by its initial.
ADDED = (2, 2, 3, 2)
ADDED_ROLE = ("user", "user", "assistant", "user")
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
FLUSH_BYTES = 4 << 20
_INITIALS = "sua?"
_BLANK, _DUPLICATE, _TRUNCATED = 4, 8, 16
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _before(row: int, after: tuple) -> tuple:
    """Costs to the end before a row (a class byte) from those after it."""
    if row & (_BLANK | _DUPLICATE):
        c = [DELETE + v for v in after]
    else:
        stay, initial = TRUNCATED * bool(row & _TRUNCATED), _INITIALS[row & 3]
        c = [min(DELETE + after[s], REROLE + stay + after[ADDED[s]],
                 stay + after[KEPT[s][initial]] if initial in KEPT[s] else DELETE + after[s]) for s in range(4)]
    c[2], c[3] = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + c[2]), min(c[1], INSERT + c[2]), c[2], c[3]


def tight_edits(rows: bytes) -> Iterator[tuple[str, int | None]]:
    """(edit, state before it) of the ASCII-least cheapest repair; every row has one of K, R, D, and inserts stand between."""
    n = len(rows)
    step = math.isqrt(n) + 1
    marks, costs = {}, END
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0:
            marks[i + 1] = costs
        costs = _before(rows[i], costs)
    state = 0
    for first in range(0, n, step):
        last = min(first + step, n)
        block = [marks.get(last, END)]
        for i in range(last - 1, first - 1, -1):
            block.append(_before(rows[i], block[-1]))
        for i in range(first, last):
            here, after = block[last - i], block[last - i - 1]
            gone, stay, initial = rows[i] & (_BLANK | _DUPLICATE), TRUNCATED * bool(rows[i] & _TRUNCATED), _INITIALS[rows[i] & 3]
            while True:
                left = here[state]
                if left == DELETE + after[state]:
                    yield "D", state
                    break
                if left == INSERT + here[ADDED[state]]:
                    yield "I", state
                    state = ADDED[state]
                    continue
                if not gone and initial in KEPT[state] and left == stay + after[KEPT[state][initial]]:
                    yield "K", state
                    state = KEPT[state][initial]
                else:
                    yield "R", state
                    state = ADDED[state]
                break
    while END[state]:
        yield "I", state
        state = ADDED[state]


class _Conversation:
    """One conversation: its facts as they arrive, then its texts against the edits."""

    def __init__(self):
        self.rows, self.count = bytearray(), dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.turn = self.initial = self.edits = None
        self.turns, self.audit = 0, bytearray()

    def fact(self, turn, role: str, blank: bool, again: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
        if fault:
            self.count[fault] += 1
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.count["illegal"] += 1
        self.initial = initial
        self.rows.append((_INITIALS.find(initial) & 3 if initial else 3) | {"blank": _BLANK, "duplicate": _DUPLICATE, "truncated": _TRUNCATED}.get(fault, 0))

    def edit(self, row: int | None) -> Iterator[tuple[str, int]]:
        """Edits up to and with the one that takes the next row (``row``: its class byte), or all that is left."""
        if self.edits is None:
            self.edits = tight_edits(bytes(self.rows))
        for name, state in self.edits:
            self.audit += name.encode()
            stay = TRUNCATED if row is not None and row & _TRUNCATED else 0
            self.count["cost"] += {"K": stay, "R": REROLE + stay, "D": DELETE, "I": INSERT}[name]
            yield name, state
            if name != "I":
                return

    def report(self) -> list:
        if self.turns:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        return [*(self.count[c] for c in _COUNTS), self.audit.decode()]


def _schema(id_type) -> StructType:
    report = [*(StructField(c, LongType()) for c in _COUNTS), StructField("audit", StringType())]
    return StructType([StructField("conv_id", id_type), StructField("seq", LongType()), StructField("edit", StringType()),
                       StructField("role", StringType()), StructField("text", StringType()), *report])


def repair_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 also: DataFrame | None = None) -> DataFrame:
    """The repaired turns of each conversation: conv_id, seq (from 0), edit (K, R or I), role, text, in order within a partition; after
    them the conversation's report row (seq NULL) with gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``also``: a table with ``id_col`` of conversations that get a report although they may have no rows.
    """
    bounded_batches(turns.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"))
    base = base.withColumn("dg", digest("text"))
    ended = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(".", "!", "?")
    facts = base.select("conv_id", "turn", "role", "dg", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (~ended).alias("truncated"))
    facts = sequence(facts, ["conv_id", "role", "dg"], [F.col("turn")], "nth")
    none = lambda kind: F.lit(None).cast(kind)
    rows = [facts.select("conv_id", F.lit(0).alias("kind"), "turn", "role", "dg", "blank", (F.col("nth") > 1).alias("again"), "truncated", none("string").alias("text")),
            base.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "dg", none("boolean").alias("blank"), none("boolean").alias("again"),
                        none("boolean").alias("truncated"), "text")]
    if also is not None:
        rows.append(also.select(F.col(id_col).alias("conv_id")).distinct().select(
            "conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("dg"),
            *[none("boolean").alias(c) for c in ("blank", "again", "truncated")], none("string").alias("text")))
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    schema = _schema(both.schema["conv_id"].dataType)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, key, now, at, seq, ids = [], 0, None, None, 0, 0, None

        def made() -> pa.RecordBatch:
            kinds = [ids, pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.names)

        def closed() -> Iterator[tuple]:
            n = seq
            for _, state in now.edit(None):
                yield key, n, "I", ADDED_ROLE[state], "", *[None] * 7
                n += 1
            yield key, None, None, None, None, *now.report()

        for b in batches:
            ids = b.schema.field(0).type
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7, 8)]
            for conv, kind, turn, role, blank, again, truncated, words in zip(*cols):
                if now is None or conv != key:
                    if now is not None:
                        out += closed()
                    key, now, at, seq = conv, _Conversation(), 0, 0
                if kind == 0:
                    if role is not None:
                        now.fact(turn, role, blank, again, truncated)
                    continue
                for name, state in now.edit(now.rows[at]):
                    if name != "D":
                        kept = (role, words) if name == "K" else (ADDED_ROLE[state], words if name == "R" else "")
                        out.append((key, seq, name, *kept, *[None] * 7))
                        size, seq = size + len(kept[1]) + 64, seq + 1
                at += 1
                if size > FLUSH_BYTES:
                    yield made()
                    out, size = [], 0
        if now is not None:
            out += closed()
        if out:
            yield made()

    near = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "dg", "again")
    return near.select("conv_id", "kind", "turn", "role", "dg", "blank", "again", "truncated", "text").mapInArrow(repair, schema)


def repair_reports(repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair_turns`' result, taken as it comes: its report and repaired_sha256 of the repaired
    ``role:text``, joined by line ends. The turns stream through the hash."""
    bounded_batches(repaired.sparkSession)
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    schema = StructType([*(repaired.schema[n] for n in names[:-1]), StructField("repaired_sha256", StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, first = hashlib.sha256(), True
        for b in batches:
            ends, shas = [], []
            for i, (seq, role, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("seq", "role", "text")))):
                if seq is None:
                    ends.append(i)
                    shas.append(sha.hexdigest())
                    sha, first = hashlib.sha256(), True
                else:
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if ends:
                done = b.take(pa.array(ends))
                yield pa.RecordBatch.from_arrays([*(done.column(n) for n in names[:-1]), pa.array(shas)], names)

    return repaired.mapInArrow(hashed, schema)


def damage_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``turns`` with faults planted by a CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text,
    2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's. NULLs are one space."""
    kind = F.col("_kind")
    rows = turns.select("conv_id", "turn", (decimal_crc(F.col("conv_id"), F.col("turn")) % 20).alias("_kind"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    text: Column = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where(kind != 0).withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "_kind")
