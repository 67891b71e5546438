"""Conversation structure repair by a streaming edit automaton.

A repaired conversation has the roles of ``s?(ua)+`` (by their first letters: system, user, assistant) or no turns.  Each
row is kept (cost 0), given the role user or assistant (3) or deleted (4); turns with an empty text may be
inserted anywhere (3).  Blank and duplicate rows must be deleted, truncated ones that stay cost 3 more.  Among
the cheapest edits the one whose letters D, I, K, R are least in ASCII order is taken.

Rows are dealt by conversation and sorted by turn (secondary sort).  One pass over the Arrow batches of a task
(``mapInArrow``: the batches of ``mapInPandas`` without the detour through pandas, which has no missing integers)
carries the costs of the automaton's four states from batch to batch; those that no cheapest edit can pass are struck
out, so the relative costs are a small finite set and each step is one lookup.  For each row a back pointer of 16 bits
says which steps are tight.  At the end of a conversation the pointers are read backwards, which leaves those on a
cheapest edit, and forwards, taking the least letter.  Pointers and rows of long conversations wait in spooled
files in the executor's own spill folder, as a sort's runs do; they belong to the attempt of the task and are made
again with it.  So memory is bounded however long a conversation is.  It stays one task's stream, since its repaired
text is one sequence.

Duplicates (role and text seen earlier) are found before: hashes of 96 bits, dealt by conversation and hash, name the turns
that repeat an earlier one, and travel to the conversation's task as marks in front of these turns; equal rows of one turn are
neighbours.  No task holds the texts or hashes of a conversation.

Defined cases: null roles and texts are one blank.  Rows come by turn, null turns first, then by role and text.
Null conversation ids are one conversation.  Repeated rows are duplicates.  A role that does not begin with s, u or a
can't be kept.  Empty tables give empty results.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import WORD

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Bytes of a conversation's rows that wait in memory; more go to the spill folder.
SPOOL_BYTES = 8 << 20
#: Back pointers in a block; full blocks go to a spooled file.
BLOCK = 1 << 16
#: Rows of a batch that is handed on, and the characters at which it is handed on earlier.
OUT_ROWS, OUT_CHARS = 4096, 4 << 20

# States: nothing yet, after system, after user, after assistant.  A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEVER = 1 << 30
#: Steps to the next turn and insertions, as (from, to); their places in a back pointer follow the four deletions.
STEPS = ((START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
INSERTS = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
STEP_BIT, INSERT_BIT, ROLE_BIT = 4, 9, 13
LETTERS = "sua"
NAMES = {USER: "user", ASSISTANT: "assistant"}


def row_code(role: str, fault: str | None) -> int:
    """What the automaton has to know of a row: initial, truncated, must go."""
    initial = LETTERS.find(role[:1]) if role else -1
    return (initial if initial >= 0 else 3) | (4 if fault == "truncated" else 0) | (8 if fault in ("blank", "duplicate") else 0)


def _settled(costs: list[int]) -> tuple[tuple[int, ...], int, int]:
    """Costs after insertions, relative to the least and without states off every cheapest edit; the least; tight insertions."""
    costs[USER] = min(costs[USER], *(costs[p] + INSERT for p, t in INSERTS if t == USER))
    costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
    tight = sum(1 << (INSERT_BIT + i) for i, (p, t) in enumerate(INSERTS) if costs[p] < NEVER and costs[p] + INSERT == costs[t])
    # From ASSISTANT every end can be reached that START (but for one deleted system turn) and SYSTEM can reach.
    if costs[START] > costs[ASSISTANT] + DELETE:
        costs[START] = NEVER
    if costs[SYSTEM] > costs[ASSISTANT]:
        costs[SYSTEM] = NEVER
    least = min(costs)
    return tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in costs), least, tight


@lru_cache(maxsize=1 << 16)
def advance(costs: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int, int]:
    """Costs after one more row, what the least grew by, and the row's back pointer."""
    initial, extra, must_go = code & 3, TRUNCATED if code & 4 else 0, code & 8
    options: list[list[tuple[int, int]]] = [[(costs[t] + DELETE, 1 << t)] for t in range(4)]
    if not must_go:
        for i, (p, t) in enumerate(STEPS):
            if initial == t - 1:
                options[t].append((costs[p] + KEEP + extra, 1 << (STEP_BIT + i)))
            elif t != SYSTEM:
                options[t].append((costs[p] + REROLE + extra, 1 << (STEP_BIT + i)))
    by_row = [min(c for c, _ in o) for o in options]
    after = list(by_row)
    settled, least, inserts = _settled(after)
    best = [s + least if s < NEVER else NEVER for s in settled]
    pointer = sum(bit for t in range(4) if best[t] < NEVER and by_row[t] == best[t] for c, bit in options[t] if c == by_row[t])
    return settled, least, pointer | inserts | initial << ROLE_BIT


FIRST, _, FIRST_POINTER = _settled([0, NEVER, NEVER, NEVER])


@lru_cache(maxsize=1 << 16)
def on_cheapest(after: int, pointer: int) -> tuple[int, int]:
    """From the states (bits) after a row that lie on a cheapest edit: those before it, and the pointer's part of such edits."""
    grown = True
    while grown:
        more = after
        for i, (p, t) in enumerate(INSERTS):
            if pointer >> (INSERT_BIT + i) & 1 and more >> t & 1:
                more |= 1 << p
        grown, after = more != after, more
    left, before = pointer & 3 << ROLE_BIT, 0
    for i, (_, t) in enumerate(INSERTS):
        left |= pointer & 1 << (INSERT_BIT + i) if after >> t & 1 else 0
    for t in range(4):
        if pointer >> t & 1 and after >> t & 1:
            left, before = left | 1 << t, before | 1 << t
    for i, (p, t) in enumerate(STEPS):
        if pointer >> (STEP_BIT + i) & 1 and after >> t & 1:
            left, before = left | 1 << (STEP_BIT + i), before | 1 << p
    return before, left


def _inserted(state: int, pointer: int) -> int | None:
    """The state after the insertion that the pointer allows in ``state``."""
    return next((t for i, (p, t) in enumerate(INSERTS) if p == state and pointer >> (INSERT_BIT + i) & 1), None)


@lru_cache(maxsize=1 << 16)
def edits_of(state: int, last: int, pointer: int) -> tuple[tuple[int, ...], str, int]:
    """Insertions before a row (as states), the row's letter and the state after it; ``last`` is the pointer before."""
    before: list[int] = []
    while True:
        if pointer >> state & 1:
            return tuple(before), "D", state
        into = _inserted(state, last)
        if into is not None:
            before.append(into)
            state = into
            continue
        initial = pointer >> ROLE_BIT & 3
        taken = [("K" if initial == t - 1 else "R", t) for i, (p, t) in enumerate(STEPS) if p == state and pointer >> (STEP_BIT + i) & 1]
        letter, state = min(taken)
        return tuple(before), letter, state


def edits_at_end(state: int, last: int) -> tuple[int, ...]:
    out: list[int] = []
    while (into := _inserted(state, last)) is not None:
        out.append(into)
        state = into
    return tuple(out)


def spill_folder() -> str | None:
    """The executor's own folder for spilled data, which Spark names to its Python workers."""
    named = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return named if named and os.path.isdir(named) else None


class Pointers:
    """The back pointers of one conversation in blocks; only the last block is in memory."""

    def __init__(self, block: int) -> None:
        self.block, self.full, self.tail, self.file = block, 0, array("H"), None

    def append(self, pointer: int) -> None:
        self.tail.append(pointer)
        if len(self.tail) == self.block:
            if self.file is None:
                self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES, dir=spill_folder())
            self.file.write(self.tail.tobytes())
            self.full, self.tail = self.full + 1, array("H")

    def _stored(self, i: int) -> array:
        self.file.seek(i * self.block * 2)
        return array("H", self.file.read(self.block * 2))

    def keep_cheapest(self, ends: int) -> None:
        """Backwards over all rows: only steps of cheapest edits stay."""

        def cut(block: array) -> None:
            nonlocal ends
            for i in range(len(block) - 1, -1, -1):
                ends, block[i] = on_cheapest(ends, block[i])

        cut(self.tail)
        for i in range(self.full - 1, -1, -1):
            block = self._stored(i)
            cut(block)
            self.file.seek(i * self.block * 2)
            self.file.write(block.tobytes())
        self.first = on_cheapest(ends, FIRST_POINTER)[1]

    def __iter__(self) -> Iterator[int]:
        for i in range(self.full):
            yield from self._stored(i)
        yield from self.tail


class Conversation:
    """Rows of one conversation with the automaton's state."""

    def __init__(self, key: object, block: int, spool: int) -> None:
        self.key, self.costs, self.total, self.n = key, FIRST, 0, 0
        self.pointers = Pointers(block)
        self.rows = tempfile.SpooledTemporaryFile(max_size=spool, dir=spill_folder())

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        self.costs, grown, pointer = advance(self.costs, row_code(role, fault))
        self.total += grown
        self.n += 1
        self.pointers.append(pointer)
        pickle.dump((turn, role, text, fault), self.rows, pickle.HIGHEST_PROTOCOL)

    def repaired(self) -> Iterator[tuple]:
        """key, turn, edit, fault, role before, role after, text, cost (of the whole conversation) of each row and insertion."""
        least = min(self.costs[s] for s in ENDS)
        cost = self.total + least
        self.pointers.keep_cheapest(sum(1 << s for s in ENDS if self.costs[s] == least))
        state, last = START, self.pointers.first
        self.rows.seek(0)
        for pointer in self.pointers:
            turn, role, text, fault = pickle.load(self.rows)
            before, letter, state = edits_of(state, last, pointer)
            for into in before:
                yield self.key, None, "I", None, None, NAMES[into], "", cost
            yield self.key, turn, letter, fault, role, NAMES[state] if letter == "R" else role, text, cost
            last = pointer
        for into in edits_at_end(state, last):
            yield self.key, None, "I", None, None, NAMES[into], "", cost


def _batches(rows: Iterator[tuple], schema: pa.Schema, long: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches; ``long`` names the column whose characters may be many."""
    waiting, chars, place = [], 0, schema.get_field_index(long)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*waiting), schema)], schema=schema)

    for row in rows:
        waiting.append(row)
        chars += len(row[place])
        if len(waiting) >= OUT_ROWS or chars >= OUT_CHARS:
            yield batch()
            waiting, chars = [], 0
    if waiting:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def marked_rows(turns: DataFrame, key: str) -> DataFrame:
    """Rows (mark 1), and in front of a turn marks (0) of what it repeats: key, turn, mark, role, text, h1, h2, empty, cut."""
    blank = F.lit(" ")
    rows = turns.select(F.col(key).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    hashed = rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.hash("text", "role"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    full = hashed.select(
        "key", "turn", F.lit(1).alias("mark"), "role", "text", "h1", "h2", (~F.col("text").rlike(WORD)).alias("empty"), (~last.isin(".", "!", "?")).alias("cut")
    )
    by_hash = Window.partitionBy("key", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    narrow = hashed.select("key", "turn", "h1", "h2").withColumn("before", F.lag(F.struct("turn")).over(by_hash))
    repeats = narrow.where(F.col("before").isNotNull() & ~F.col("before.turn").eqNullSafe(F.col("turn")))
    no, nothing = F.lit(False), F.lit("")
    marks = repeats.select("key", "turn", F.lit(0).alias("mark"), nothing.alias("role"), nothing.alias("text"), "h1", "h2", no.alias("empty"), no.alias("cut"))
    return full.unionByName(marks)


def repaired_turns(turns: DataFrame, key: str = "conv_id", block: int = BLOCK, spool: int = SPOOL_BYTES) -> DataFrame:
    """Every row of ``turns`` and every inserted turn, in the conversation's order within a partition.

    Columns: the key, turn (null for insertions), edit (K, R, D or I), fault (blank, duplicate, truncated or null),
    role_before (null for insertions), role and text as repaired (as they were for D), cost of the conversation's edits.
    """
    stream = marked_rows(turns, key).repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "mark", "role", "text")
    texts = [ST.StructField(n, ST.StringType()) for n in ("edit", "fault", "role_before", "role", "text")]
    out = ST.StructType([ST.StructField(key, turns.schema[key].dataType), ST.StructField("turn", ST.LongType()), *texts, ST.StructField("cost", ST.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_repaired(batches, block, spool), schema, "text")

    return stream.mapInArrow(run, out)


def _repaired(batches: Iterator[pa.RecordBatch], block: int, spool: int) -> Iterator[tuple]:
    """The repaired rows of a task's conversations, from its rows and marks in order."""
    current, now, repeated, previous = None, None, set(), None
    for key, turn, mark, role, text, h1, h2, empty, cut in _rows(batches):
        if current is None or current.key != key:
            if current is not None:
                yield from current.repaired()
            current, now, repeated, previous = Conversation(key, block, spool), turn, set(), None
        elif turn != now:
            now, repeated, previous = turn, set(), None
        if not mark:
            repeated.add((h1, h2))
            continue
        same = (h1, h2) in repeated or (h1, h2) == previous
        previous = (h1, h2)
        current.add(turn, role, text, "blank" if empty else "duplicate" if same else "truncated" if cut else None)
    if current is not None:
        yield from current.repaired()


LEGAL = {"su", "ua", "au"}


def _report(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row per conversation, from its repaired rows in order."""
    for key, of_key in groupby(rows, lambda r: (r[0],)):
        turns, least, most, last, initial = 0, None, None, None, None
        faults, illegal, cost = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        audit, digest, joined = bytearray(), hashlib.sha256(), b""
        for _, turn, edit, fault, before, role, text, cost in of_key:
            audit += edit.encode()
            if edit != "D":
                digest.update(joined + f"{role}:{text}".encode())
                joined = b"\n"
            if edit == "I":
                continue
            if fault:
                faults[fault] += 1
            if initial is not None and initial + before[:1] not in LEGAL:
                illegal += 1
            initial = before[:1]
            if turn is not None and turn != last:
                least, most, last, turns = turn if least is None else least, turn, turn, turns + 1
        gaps = most - least + 1 - turns if turns else 0
        yield key[0], gaps, *faults.values(), illegal, cost, audit.decode(), digest.hexdigest()


def conversation_reports(turns: DataFrame, key: str = "conv_id", block: int = BLOCK, spool: int = SPOOL_BYTES) -> DataFrame:
    """One row per conversation of ``turns``: what was wrong with it, the cheapest repair and a digest of its repaired text.

    Columns: the key, gaps (missing turn numbers), blank, duplicate, truncated, illegal (neighbouring roles), cost, audit (the
    edits' letters) and repaired_sha256 (of ``role:text`` of the repaired turns, joined by line ends).
    """
    numbers = [ST.StructField(n, ST.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ST.StructType([ST.StructField(key, turns.schema[key].dataType), *numbers, ST.StructField("audit", ST.StringType()), ST.StructField("repaired_sha256", ST.StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_report(_rows(batches)), schema, "audit")

    return repaired_turns(turns, key, block, spool).mapInArrow(run, out)
