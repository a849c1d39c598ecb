"""Repair of conversations: every edit sequence tried, awkward rows, long and split streams."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF
from plateauscope.llm import conversations as C
from test_corpus import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"
TAKES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        said = text.rstrip(C.WHITE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen
                   else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, repaired rows) by trying every sequence of edits, cheapest first."""
    found = faults(rows)
    todo, done = [(0, "", 0, "", ())], {}
    best = []
    while todo:
        todo.sort()
        cost, edits, at, last, out = todo.pop(0)
        if best and cost > best[0][0]:
            break
        if done.setdefault((at, last), cost) + 0 < cost:
            continue
        if at == len(rows) and last in ("", "a"):
            best.append((cost, edits, out))
        follow = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        if not edits.endswith("IIII"):
            todo.append((cost + 2, edits + "I", at, follow, (*out, (name, ""))))
        if at < len(rows):
            role, text = rows[at]
            todo.append((cost + 3, edits + "D", at + 1, last, out))
            if found[at] not in ("blank", "duplicate"):
                more = found[at] == "truncated"
                if (last, role[:1]) in TAKES:
                    todo.append((cost + more, edits + "K", at + 1, role[:1], (*out, (role, text))))
                todo.append((cost + 2 + more, edits + "R", at + 1, follow, (*out, (name, text))))
    return min(best)


def expected(rows):
    """The report of plain rows (turn, role, text) of one conversation, nulls as one space."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)
    turns = {t for t, _, _ in rows if t is not None}
    said = [r[1:] for r in rows]
    found = faults(said)
    cost, edits, out = cheapest(said)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits,
            hashlib.sha256(text.encode()).hexdigest())


def as_dict(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Fine.", "Cut", "Why?", "", " \n", "No!", "x", "Fine. \t", None]
    roles = ["system", "user", "assistant", "tool", "", None, "unicorn"]
    out = []
    for c in range(250):
        for t in range(rng.randint(1, 7)):
            out.append((c if c else None, rng.choice([t, t, t + 3, None]),
                        rng.choice(roles[1:3] * 3 + roles), rng.choice(texts + ["t%d." % t] * 6)))
    return out


def test_report_equals_every_sequence_tried(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES
                                                             if c not in ("text",)})
    got = as_dict(C.report(frame.repartition(5)))
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    assert got.keys() == by.keys()
    for c, group in by.items():
        assert got[c] == expected(group), (c, group)


def test_repaired_rows_give_the_digest(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    text = {}
    for r in C.repaired(frame).orderBy("position").collect():
        text.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, r in as_dict(C.report(frame)).items():
        assert r[-1] == hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest()
        assert len(text.get(c, [])) == sum(r[-2].count(k) for k in "KRI")


def test_absent_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report(none).count() == 0 and C.repaired(none).count() == 0
    only = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, None, None)], SCHEMA)
    got = as_dict(C.report(only.withColumn("present", F.lit(False))))
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: zero, 2: zero}


def _stream(rows):
    """The stream alone over rows in order, with small batches."""
    steps, seen = C._Steps(), set()
    one = C._Conversation("1", steps, None)
    for t, (role, text) in enumerate(rows):
        one.row(t, role, text, (role, text) not in seen)
        seen.add((role, text))
    assert len(steps.list) < 2000
    return one.finish()


def test_spilled_rows_change_nothing(monkeypatch):
    rng = random.Random(3)
    for case in range(60):
        n = rng.randint(1, 60)
        rows = [(rng.choice(["user", "assistant", "tool"]),
                 rng.choice(["a.", "", "b", f"t{i}.", f"c{i}"])) for i in range(n)]
        plain = _stream(rows)
        with monkeypatch.context() as m:
            m.setattr(C, "HELD_ROWS", rng.choice([1, 2, 3]))
            assert _stream(rows) == plain


def test_giant_conversations_stay_small(monkeypatch):
    held = []
    add = C._Waiting.add
    monkeypatch.setattr(C._Waiting, "add", lambda self, *a: (add(self, *a), held.append(len(self.rows))))
    turns = [("user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(40_000)]
    out = _stream(turns)
    assert out[6:8] == (0, "K" * 40_000) and max(held) <= 2
    held.clear()
    out = _stream([("user", "")] * 20_000 + turns)  # deleted, whichever state it began in
    assert out[6] == 60_000 and out[7] == "D" * 20_000 + "K" * 40_000
    assert max(held) <= C.HELD_ROWS


def test_damage_and_query(spark, tmp_path):
    rows = [(c if c else None, t, ["user", "assistant", None][(t or 0) % 3], f"Turn {t}. Yes! No?")
            for c in range(60) for t in (None, 0, 1, 2, 3)]
    out = {}
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(fate, text)
        role = "user" if fate == 4 else role
        out.setdefault(c, []).extend([(t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = as_dict(queries()["op11_conversation_repair"](spark, str(tmp_path)))
    assert got == {c: expected(r) for c, r in out.items()}


def test_query_over_the_given_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    out = {}
    for r in rows:
        fate = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = {1: "", 2: r.text.translate(str.maketrans("", "", ".!?"))}.get(fate, r.text)
        role = "user" if fate == 4 else r.role
        out.setdefault(r.conv_id, []).extend(
            [(r.turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    got = as_dict(queries()["op11_conversation_repair"](spark, SF))
    assert got == {c: expected(r) for c, r in out.items()}
