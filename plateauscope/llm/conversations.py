"""Repair of conversation structure by cheapest edits, as a stream over rows in order of turn.

Roles of a repaired conversation begin with ``s`` once or never, then ``u`` and ``a`` in turn, and
end with ``a``; no rows at all are right too. Each row is kept, given another role or deleted, and
empty rows may be inserted; the cheapest edits win, among equals the least string of initials.

Rows are dealt by conversation, sorted by turn in the task, and read once. Four states (nothing
yet, system, user, assistant last) carry cost and rank from row to row and from Arrow batch to Arrow
batch. Where one state is left, all before it is settled: edits and texts leave the task's memory at
once. States that cannot win any more are dropped, so this happens every few rows; rows that wait
longer are spilled, as two bytes of backpointer each and their texts, to an unnamed file.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import tempfile
from array import array

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1  # added for a truncated row that is not deleted
WHITE = " \t\n\x0b\x0c\r"
HELD_ROWS, HELD_BYTES = 4096, 4 << 20  # rows that wait in memory before they are spilled

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER,
          (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
# What a state may at most cost more than another until the end: it copies the other's edits
# after inserting a row, or deletes the one row that it cannot take over.
_BEHIND = {(3, 2): 2, (2, 3): 2, (3, 0): 3, (3, 1): 0, (2, 0): 5, (2, 1): 2, (0, 3): 0,
           (0, 1): 0, (0, 2): 2, (1, 2): 2, (1, 3): 4, (1, 0): 4}


def _next_role(state: int) -> str:
    return "a" if state == _USER else "u"


def _moves(initial: str, forced: bool, truncated: bool) -> list[dict[int, tuple[int, str]]]:
    """From each state: the cheapest, then least edits of one row to every other state."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        here, cost, edits = state, 0, ""
        for _ in range(4):  # up to three rows inserted before it
            steps = [(here, DELETE, "D")]
            if not forced:
                if (here, initial) in _AFTER:
                    steps.append((_AFTER[here, initial], KEEP + truncated * TRUNCATED, "K"))
                steps.append((_AFTER[here, _next_role(here)], REROLE + truncated * TRUNCATED, "R"))
            for to, more, letter in steps:
                best[to] = min(best.get(to, (99, "")), (cost + more, edits + letter))
            here, cost, edits = _AFTER[here, _next_role(here)], cost + INSERT, edits + "I"
        out.append(best)
    return out


_CLASSES = [(i, f, t) for i in "sua?" for f, t in ((True, False), (False, False), (False, True))]
_MOVES = [_moves(*c) for c in _CLASSES]
_PLACE = {c: i for i, c in enumerate(_CLASSES)}


class _Steps:
    """Steps between sets of states: costs above the least and ranks, computed once each."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.list: list[tuple] = []

    def step(self, states: tuple, kind: int) -> int:
        """Number of the step from ``states`` ((state, cost, rank), ...) over a row of ``kind``."""
        at = self.known.get((states, kind))
        if at is None:
            at = self.known[states, kind] = len(self.list)
            self.list.append(self._made(states, _MOVES[kind]))
        return at

    @staticmethod
    def _made(states, moves):
        best: dict[int, tuple] = {}
        for state, cost, rank in states:
            for to, (more, edits) in moves[state].items():
                new = (cost + more, rank, edits, state)
                if to not in best or new < best[to]:
                    best[to] = new
        live = [s for s in best
                if not any(best[m][0] + _BEHIND[m, s] < best[s][0] for m in best if m != s)]
        least = min(best[s][0] for s in live)
        ranked = {s: i for i, s in enumerate(sorted(live, key=lambda s: best[s][1:3]))}
        after = tuple((s, best[s][0] - least, ranked[s]) for s in sorted(live))
        back = {s: (best[s][3], best[s][2]) for s in live}
        return after, least, back


class _Waiting:
    """Rows whose edits are not settled: number of the step, role and text of each."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.steps, self.rows, self.bytes = array("H"), [], 0
        self.sizes, self.files, self.places = [], None, [0]

    def add(self, step: int, row: tuple | None, size: int):
        self.steps.append(step)
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= HELD_ROWS or self.bytes >= HELD_BYTES:
            if self.files is None:
                self.files = [tempfile.TemporaryFile() for _ in range(3)]
            self.steps.tofile(self.files[0])
            pickle.dump(self.rows, self.files[1])
            self.places.append(self.files[1].tell())
            self.sizes.append(len(self.rows))
            self.steps, self.rows, self.bytes = array("H"), [], 0

    def settle(self, state: int, steps: _Steps):
        """(edits, row) of every waiting row in order, the last of which ends in ``state``."""
        def back(numbers, state):
            edits = [""] * len(numbers)
            for i in range(len(numbers) - 1, -1, -1):
                state, edits[i] = steps.list[numbers[i]][2][state]
            return edits, state

        last, state = back(self.steps, state)
        spilled = []
        if self.files:
            numbers_file, rows_file, edits_file = self.files
            for size, before in reversed(list(zip(self.sizes, itertools.accumulate(
                    self.sizes, initial=0)))):
                numbers = array("H")
                numbers_file.seek(2 * before)
                numbers.fromfile(numbers_file, size)
                edits, state = back(numbers, state)
                spilled.append(edits_file.tell())
                pickle.dump(edits, edits_file)
            for place, edits_at in zip(self.places, reversed(spilled)):
                rows_file.seek(place)
                edits_file.seek(edits_at)
                yield from zip(pickle.load(edits_file), pickle.load(rows_file))
        yield from zip(last, self.rows)
        for f in self.files or ():
            f.close()
        self.clear()


class _Conversation:
    """Faults, edits and repaired rows of one conversation, fed row by row in order of turn."""

    def __init__(self, key, steps: _Steps, emit):
        self.key, self.steps, self.emit = key, steps, emit
        self.states, self.cost, self.out = ((_START, 0, 0),), 0, _START
        self.waiting = _Waiting()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high, self.role = 0, None, None, None
        self.audit: list[str] = []
        self.hash, self.rows = hashlib.sha256(), 0

    def row(self, turn: int | None, role: str, text: str, first: bool):
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.role is not None and self.role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = initial
        said = text.rstrip(WHITE)
        cut = False
        forced = not said or not first
        if not said:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        elif said[-1] not in ".!?":
            cut = True
            self.truncated += 1
        initial = initial if initial and initial in "sua" else "?"
        number = self.steps.step(self.states, _PLACE[initial, forced, cut])
        self.states, more, _ = self.steps.list[number]
        self.cost += more
        self.waiting.add(number, None if forced else (role, text),
                         0 if forced else len(role) + len(text))
        if len(self.states) == 1:
            self._settle(self.states[0][0])

    def _write(self, edit: str, role: str, text: str):
        line = f"{role}:{text}"
        self.hash.update((("\n" if self.rows else "") + line).encode("utf-8", "surrogatepass"))
        if self.emit is not None:
            self.emit(self.key, self.rows, edit, role, text)
        self.rows += 1

    def _apply(self, edits: str, row: tuple | None):
        self.audit.append(edits)
        for letter in edits:
            if letter == "D":
                continue
            role, text = row if letter in "KR" else ("", "")
            initial = _next_role(self.out) if letter in "RI" else role[0]
            if letter in "RI":
                role = {"u": "user", "a": "assistant"}[initial]
            self.out = _AFTER[self.out, initial]
            self._write(letter, role, text)

    def _settle(self, state: int):
        for edits, row in self.waiting.settle(state, self.steps):
            self._apply(edits, row)

    def finish(self) -> tuple:
        ends = []
        for state, cost, rank in self.states:
            more = {_START: 0, _ASSISTANT: 0, _USER: 1, _SYSTEM: 2}[state]
            ends.append((cost + more * INSERT, rank, "I" * more, state))
        cost, _, edits, state = min(ends)
        self._settle(state)
        self._apply(edits, None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                self.cost + cost, "".join(self.audit), self.hash.hexdigest())


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted by turn; ``first`` where role and text are new.

    One shuffle: the window over equal rows of a conversation keeps the partitioning.
    """
    columns = {"id": F.col("conv_id"), "turn": F.col("turn").cast("long")}
    for c in ("role", "text"):
        columns[c] = F.coalesce(F.col(c).cast("string"), F.lit(" "))
    columns["present"] = (F.coalesce(F.col("present"), F.lit(False)) if "present" in rows.columns
                          else F.lit(True))
    rows = rows.select(*(v.alias(k) for k, v in columns.items()))
    turn = F.col("turn").asc_nulls_first()
    again = Window.partitionBy("id", "present", "role", "text").orderBy(turn)
    return (rows.repartition("id").withColumn("first", F.row_number().over(again) == 1)
            .sortWithinPartitions("id", turn, "role", "text")
            .select(F.col("id").cast("string").alias("key"),
                    F.col("turn").cast("string").alias("turn"), "role", "text", "present", "first"))


def _streamed(rows: DataFrame, want_rows: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    fields = ([("position", "bigint"), ("edit", "string"), ("role", "string"), ("text", "string")]
              if want_rows else [*((c, "bigint") for c in _REPORT),
                                 ("audit", "string"), ("repaired_sha256", "string")])
    schema = "key string, " + ", ".join(f"{n} {t}" for n, t in fields)
    names = ["key", *(n for n, _ in fields)]

    def run(batches):
        steps, out, one = _Steps(), [], None
        emit = (lambda *row: out.append(row)) if want_rows else None

        def done():
            last = one.finish()
            if not want_rows:
                out.append(last)

        def full():
            frame = pd.DataFrame(out, columns=names)
            out.clear()
            return frame

        for batch in batches:
            for key, turn, role, text, present, first in zip(*(
                    batch[c].tolist() for c in ("key", "turn", "role", "text", "present", "first"))):
                key = key if isinstance(key, str) else None
                if one is None or key != one.key:
                    if one is not None:
                        done()
                    one = _Conversation(key, steps, emit)
                if present:
                    one.row(int(turn) if isinstance(turn, str) else None, role, text, first)
                if len(out) >= 2000:
                    yield full()
        if one is not None:
            done()
        if out:
            yield full()

    found = _in_order(rows).mapInPandas(run, schema)
    return found.select(F.col("key").cast(kind).alias("conv_id"), *(n for n, _ in fields))


def report(rows: DataFrame) -> DataFrame:
    """Per conversation: faults, cost and initials of its cheapest edits, digest of the repaired rows.

    ``rows(conv_id, turn, role, text)``; a null role or text is one space, null turns come first,
    rows of one turn are ordered by role and text, rows without conv_id are one conversation. Where
    a boolean column ``present`` is false or null, the row only names its conversation, which then
    may have no rows at all: zeros, no edits, digest of the empty text. An empty table gives no rows.
    Other columns are ignored. One conversation, however long, is one stream in one task: memory
    is bounded by ``HELD_BYTES``, apart from its string of edits, one byte a row.
    """
    return _streamed(rows, False)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of every repaired row: K kept, R other role, I inserted.

    Rows and awkward cases as in :func:`report`; a conversation without rows is absent.
    """
    return _streamed(rows, True)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with planted faults by crc32(``conv_id:turn``) modulo 20, nulls as one space.

    0 drops the row (it stays with ``present`` false), 1 empties its text, 2 removes ``.!?``,
    3 repeats it, 4 makes its role user.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"),
                       fate.alias("fate"))
    times = F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("fate") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
