"""Repeated byte strings: groups of equal windows, refined digit by digit as a radix sort would.

A suffix matters through its first ``length`` bytes (its window). Groups are refined by one digit
after the other, and a pass goes on only with groups of more than one member, until equal
groups have agreed on the whole window. The digits are hashes of parts of the window and not its
leading bytes, so suffixes are grouped and not put in order:

1. The first digit of a window is the ``GRAM``-byte string of smallest hash inside it, leftmost
   if several. It depends on the window alone, so equal windows have equal digits, and
   neighbouring suffixes mostly share theirs: such a run of suffixes travels as one row.
2. The second digit is the whole run (bytes and place of the first digit). Runs that occur
   twice are repeated windows throughout. A run that differs from all others of its group, but
   is in a group with others, goes on as single suffixes; one row per different run joins it.
3. The last digit is the rest of the window: groups of two or more are repeated.

Digits are compared by 64-bit hashes. Everything is judged on the input; the bytes of repeated
windows are removed from all documents that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateauscope.llm import tokens as T
from plateauscope.llm.tables import written

LENGTH = 200
GRAM = 40
# Rows of one group that a task holds; a larger group takes its last pass by a shuffle.
HELD_ROWS = 20_000
_LOW = np.uint64(0xFFFFFFFF)
_TAG = np.uint64(0xD6E8FEB86659FD93)
_RUN = "h long, u long, key long, n int, s int, c int, o int, kind int"
_NAMES = ["h", "u", "key", "n", "s", "c", "o", "kind"]
# Kinds of a run in the first pass: alone in its batch, one for several of its batch, known.
ALONE, SEVERAL, KNOWN = 0, 1, 2


def _prefix(data: np.ndarray):
    """Hash sums: ``sums[j] - sums[i]`` times ``down[i]`` depends on bytes i..j-1 alone."""
    up, down = T._powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum(T._BYTE[data] * up[:len(data)], dtype=np.uint64)])
    return sums, down


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start, count, place, h, u) of the runs of windows that share their first digit.

    ``start`` is the first window of the run, from the row's first byte; ``place`` is where the
    digit stands from there; ``h`` and ``u`` are the hashes of digit and run.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, down = _prefix(data)
    digit = T.mix((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])
    low = (digit & ~_LOW) | np.arange(len(digit), dtype=np.uint64)
    reach, wide = length - gram + 1, 1
    while wide * 2 <= reach:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < reach:
        low = np.minimum(low[:len(low) - (reach - wide)], low[reach - wide:])
    at = (low & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(row[:len(at)] == row[length - 1:length - 1 + len(at)])
    if not len(inside):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at, row = at[inside], row[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    start = inside[first]
    last = inside[np.append(first[1:], len(inside)) - 1]
    at, row = at[first], row[first]
    count, place = last - start + 1, at - start
    whole = (sums[last + length] - sums[start]) * down[start]
    u = T.mix(whole + (place * (1 << 20) + count).astype(np.uint64) * _TAG)
    return row, start - offsets[row], count, place, digit[at], u


def _first_pass(length: int, gram: int):
    """Task: the runs of every text. Runs seen twice in a batch are known; one stands for them."""
    def run(batches):
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            got = []
            for lo, hi in T.chunks(offsets):
                base = offsets[lo]
                r, *rest = runs(data[base:offsets[hi]], offsets[lo:hi + 1] - base, length, gram)
                got.append((r + lo, *rest))
            if not got:
                continue
            row, start, count, place, h, u = (np.concatenate(c) for c in zip(*got))
            if not len(row):
                continue
            order = np.lexsort((u, h))
            same = np.zeros(len(row), bool)
            same[1:] = (h[order[1:]] == h[order[:-1]]) & (u[order[1:]] == u[order[:-1]])
            twice = same.copy()
            twice[:-1] |= same[1:]
            stands = order[twice & ~same]
            known = np.zeros(len(row), bool)
            known[order[twice]] = True
            kind = np.where(known, KNOWN, ALONE)
            take = np.concatenate([np.arange(len(row)), stands])
            kind = np.concatenate([kind, np.full(len(stands), SEVERAL)])
            sent = h[take]
            spread = kind == KNOWN  # known runs need no group and are dealt out evenly
            sent[spread] = T.mix(start[take[spread]].astype(np.uint64)
                                 + keys[row[take[spread]]].view(np.uint64))
            r = row[take]
            for lo in range(0, len(take), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent[at].view(np.int64)), pa.array(u[take[at]].view(np.int64)),
                     pa.array(keys[r[at]]),
                     *(pa.array(x.astype(np.int32)) for x in (
                         np.diff(offsets)[r[at]], start[take[at]], count[take[at]],
                         place[take[at]], kind[at]))], names=_NAMES)
    return run


def _second_pass(batches):
    """Task over rows sorted by (h, u): kind KNOWN rows are repeated; of every different run of
    a group with several, one row goes on: SEVERAL if it is known to repeat, else ALONE."""
    def settle(t: pa.RecordBatch, before, after):
        h, u, kind = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "u", "kind"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (u[1:] != u[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        several = np.maximum.reduceat(kind, first) == SEVERAL
        full = several | (last > first)
        prev = np.zeros(len(first), bool)
        prev[1:] = h[first[1:]] == h[first[1:] - 1]
        prev[0] = before is not None and before == h[0]
        then = np.zeros(len(first), bool)
        then[:-1] = h[last[:-1]] == h[last[:-1] + 1]
        then[-1] = after is not None and after == h[-1]
        done = np.flatnonzero(np.repeat(full, last - first + 1) & (kind != SEVERAL))
        on = np.flatnonzero(prev | then)
        at = np.concatenate([done, first[on]])
        if len(at):
            kinds = np.concatenate([np.full(len(done), KNOWN), np.where(full[on], SEVERAL, ALONE)])
            out = t.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*out.columns[:-1], pa.array(kinds.astype(np.int32))], names=_NAMES)

    held, before = None, None
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        known = kind == KNOWN
        if known.any():
            yield batch.filter(pa.array(known))
            batch = batch.filter(pa.array(~known))
        if batch.num_rows == 0:
            continue
        parts = [held, batch] if held is not None else [batch]
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        h, u = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "u"))
        differ = np.flatnonzero((h != h[-1]) | (u != u[-1]))
        cut = int(differ[-1]) + 1 if len(differ) else 0
        if cut:
            yield from settle(t.slice(0, cut), before, h[cut])
            before = h[cut - 1]
        held = t.slice(cut)
        if held.num_rows > 2:  # a run of many copies: all but two are settled
            k = held.column("kind").to_numpy(zero_copy_only=False)
            rest = held.slice(2).filter(pa.array(k[2:] != SEVERAL))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[:-1], pa.array(np.full(rest.num_rows, KNOWN, np.int32))],
                    names=_NAMES)
            held = held.slice(0, 2)
    if held is not None:
        yield from settle(held, before, None)


_EDGE = "h long, key long, n int, s int, o int, kind int, body binary"
_EDGE_NAMES = ["h", "key", "n", "s", "o", "kind", "body"]


def _bodies(length: int):
    """Task: the bytes of the runs that go on as single suffixes."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [[] for _ in _EDGE_NAMES]
            for key, n, z, found in zip(*(batch.column(c).to_pylist()
                                          for c in ("key", "n", "z", "runs"))):
                text = unpack.decompress(z) if n else b""
                for r in found:
                    row = (r["h"], key, n, r["s"], r["o"], r["kind"],
                           text[r["s"]:r["s"] + r["c"] - 1 + length])
                    for column, x in zip(out, row):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(),
                     pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=_EDGE_NAMES)
    return run


def _windows(t, length: int):
    """(row, window, hash) of every window of the rows' bodies; equal within a group iff equal."""
    body = t.column("body")
    body = body.cast(pa.large_binary())
    _, at, data = body.buffers()
    offsets = np.frombuffer(at, np.int64)[body.offset:body.offset + len(body) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    h, o = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "o"))
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    sums, down = _prefix(data)
    s = offsets[row] + step
    value = (sums[s + length] - sums[s]) * down[s]
    return row, step, T.mix(value + T.mix(h[row].view(np.uint64)
                                          + (o[row] - step).astype(np.uint64) * _TAG))


_SPAN = "key long, n int, s int, c int"


def _spans(t, row: np.ndarray, step: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring windows (sorted by row and step) as spans."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    key, n, s = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "s"))
    r = row[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[r]), pa.array(n[r]), pa.array((s[r] + step[first]).astype(np.int32)),
         pa.array((last - first + 1).astype(np.int32))], names=["key", "n", "s", "c"])


def _last_pass(length: int, held_rows: int):
    """Task over rows sorted by h: repeated windows of the ALONE rows, as spans of kind 0; rows of
    groups too large for a task come back whole with kind 1 and go by :func:`_exploded`."""
    schema = pa.schema([("wide", pa.bool_()), ("key", pa.int64()), ("n", pa.int32()),
                        ("s", pa.int32()), ("c", pa.int32()), ("h", pa.int64()),
                        ("o", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])

    def found(t):
        kind = t.column("kind").to_numpy(zero_copy_only=False)
        row, step, value = _windows(t, length)
        _, place, n = np.unique(value, return_inverse=True, return_counts=True)
        at = np.flatnonzero((n[place] > 1) & (kind[row] == ALONE))
        if len(at):
            spans = _spans(t, row[at], step[at])
            k = spans.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, bool)), *spans.columns, pa.nulls(k, pa.int64()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                schema=schema)

    def wide(t):
        k = t.num_rows
        c = lambda name: t.column(name)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, bool)), c("key"), c("n"), c("s"), pa.nulls(k, pa.int32()), c("h"),
             c("o"), c("kind"), c("body")], schema=schema)

    def slices(t):
        """Whole groups of at most about ``held_rows`` rows."""
        h = t.column("h").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lo = 0
        while lo < len(h):
            i = int(np.searchsorted(first, lo + 2000, "right"))
            hi = int(first[i]) if i < len(first) else len(h)
            yield t.slice(lo, hi - lo)
            lo = hi

    def run(batches):
        held, large = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            h = batch.column("h").to_numpy(zero_copy_only=False)
            if large is not None:
                to = int(np.searchsorted(h, large, "right"))
                if to:
                    yield from wide(batch.slice(0, to))
                    batch, h = batch.slice(to), h[to:]
                if not len(h):
                    continue
                large = None
            parts = [held, batch] if held is not None else [batch]
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            h = t.column("h").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(h, h[-1]))
            for part in slices(t.slice(0, cut)):
                yield from found(part)
            held = t.slice(cut)
            if held.num_rows > held_rows:
                large = int(h[-1])
                yield from wide(held)
                held = None
        if held is not None:
            yield from found(held)
    return run, ("wide boolean, key long, n int, s int, c int, h long, o int, kind int, body binary")


def _exploded(length: int):
    """Task: (w, key, n, s, alone) of every window of the rows of large groups."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                t = batch.slice(lo, 2000)
                row, step, value = _windows(t, length)
                key, n, s, kind = (t.column(c).to_numpy(zero_copy_only=False)
                                   for c in ("key", "n", "s", "kind"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(key[row]), pa.array(n[row]),
                     pa.array((s[row] + step).astype(np.int32)), pa.array(kind[row] == ALONE)],
                    names=["w", "key", "n", "s", "alone"])
    return run, "w long, key long, n int, s int, alone boolean"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, z): whole texts, compressed for the shuffle."""
    names = ["doc_id", "key", "n", "z"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                data, offsets = T.utf8(part.column("text"))
                view = data.tobytes()
                z = [pack.compress(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"),
                     pa.array(np.diff(offsets).astype(np.int32)), pa.array(z, pa.binary())],
                    names=names)
    return docs.mapInArrow(run, "doc_id long, key long, n int, z binary")


def _removed(length: int):
    """Task: (doc_id, n_bytes, spans, kept) of every text."""
    item = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                        ("spans", pa.list_(item)), ("kept", pa.binary())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                spans, kept = [], []
                for n, z, at in zip(*(part.column(c).to_pylist() for c in ("n", "z", "spans"))):
                    text = unpack.decompress(z) if n else b""
                    merged: list[list[int]] = []
                    for x in sorted(at or ()):
                        start, end = x >> 32, (x >> 32) + (x & 0xFFFFFFFF) - 1 + length
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    edges = [0, *(e for s in merged for e in s), n]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n").cast(pa.int64()),
                     pa.array(spans, pa.list_(item)), pa.array(kept, pa.binary())], schema=schema)
    return run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                    held_rows: int = HELD_ROWS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs(doc_id, text)``.

    ``spans`` are the maximal runs of bytes covered by ``length``-byte strings that start
    anywhere else too; ``kept`` is the rest. A null or short text has no such string. Rows
    that repeat a doc_id, or have none, are texts of their own (and repeat each other if
    equal). Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    first = (docs.filter(F.octet_length("text") >= length).select("key", "text")
             .mapInArrow(_first_pass(length, gram), _RUN))
    # Rows of one digit may be many: a task streams them and holds two of equal runs.
    second = written(first.repartition("h").sortWithinPartitions("h", "u")
                     .mapInArrow(_second_pass, _RUN), "runs", by=["kind"])
    known = second.filter(F.col("kind") == KNOWN).select("key", "n", "s", "c")

    packed = _packed(docs)
    on = second.filter(F.col("kind") != KNOWN)
    listed = on.groupBy("key", "n").agg(
        F.collect_list(F.struct("h", "s", "c", "o", "kind")).alias("runs"))
    bodies = packed.drop("doc_id").join(listed, ["key", "n"]).mapInArrow(_bodies(length), _EDGE)
    run, schema = _last_pass(length, held_rows)
    third = written(bodies.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema),
                    "windows", by=["wide"])
    spans = known.unionByName(third.filter("NOT wide").select("key", "n", "s", "c"))
    wide = third.filter("wide")
    if not wide.isEmpty():
        run, schema = _exploded(length)
        each = wide.select(*_EDGE_NAMES).mapInArrow(run, schema)
        # The last digit of a large group: counted with map-side combine, then handed back.
        again = each.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
        spans = spans.unionByName(each.filter("alone").join(again, "w").select(
            "key", "n", "s", F.lit(1).alias("c")))
    pack = F.shiftleft(F.col("s").cast("long"), 32) + F.col("c")
    spans = spans.groupBy("key", "n").agg(F.collect_set(pack).alias("spans"))
    run, schema = _removed(length)
    return packed.join(spans, ["key", "n"], "left").select("doc_id", "n", "z", "spans").mapInArrow(
        run, schema)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return without_repeats(docs, length).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
