"""N-gram Jaccard join: distinct word shingles, a prefix tree and components of its links.

The sets are ordered by one global order: shingles that many sets hold come last, the others
by their hash. Two sets of Jaccard similarity ``t`` or more share a shingle among the first
``n - ceil(t * n) + 1`` of each, so a set is stored below each of these first shingles only;
the shingle is the first level of the tree and the key of the shuffle. Inside a subtree the
members are joined in rounds. A round gives every set that is not yet connected to the whole
subtree a few partners; what is left after the rounds is every pair of members from different
components that the length and position bounds admit, and in large subtrees blocks of members
against blocks. A set is verified against several by walking their prefix tree (:func:`walk`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateauscope.llm import tokens as T
from plateauscope.llm.components import connected
from plateauscope.llm.tables import written

NUM, DEN, WIDTH = 75, 100, 5
# Sets that must hold a shingle before it moves to the end of the order. The order decides the
# work of the join and never its result.
FREQUENT, FREQUENT_KEPT = 8, 1 << 19
COUNTED = 1 << 22  # shingles whose counts a task takes together
PARTNERS = (1, 4, 8)  # partners a set gets in each round
LAGS = 64
NEVER = 2 ** 31 - 1
HELD = 256  # sets a block of a large subtree
ODD = 1 << 62  # nodes of rows whose doc_id has several texts lie above, doc_ids that are nodes below
_TOP = np.uint64(1) << np.uint64(62)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bounds, shingle hashes below 2^62) of ranges of rows."""
    data, offsets = T.utf8(batch.column("text"))
    for lo, hi in T.chunks(offsets):
        base = offsets[lo]
        row, word, _, _ = T.words(data[base:offsets[hi]], offsets[lo:hi + 1] - base)
        r, h = T.shingles(row, word & (_TOP - np.uint64(1)), hi - lo, width)
        h = h >> np.uint64(2)
        new = np.ones(len(r), bool)  # the shift may have made two equal
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        r, h = r[new], h[new]
        yield lo, hi, np.searchsorted(r, np.arange(hi - lo + 1)), h


def _signature(bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set: equal sets have equal sums."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
        run = np.concatenate([np.zeros(1, np.uint64),
                              np.cumsum(T.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(T.mix(run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _summarise(width: int):
    """Task: a row per document (kind 0: id, size, signature) and per shingle that several sets of
    the task hold (kind 1: count, shingle)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()),
                        ("s1", pa.int64()), ("s2", pa.int64())])

    def counted(parts: list[np.ndarray]):
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        value, count = value[count > 1], count[count > 1]
        k = len(value)
        if k:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(count),
                 pa.array(value.view(np.int64)), pa.nulls(k, pa.int64())], schema=schema)

    def run(batches):
        parts: list[np.ndarray] = []
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, bounds, h in _sets(batch, width):
                s1, s2 = _signature(bounds, h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(hi - lo, np.int32)), ids.slice(lo, hi - lo),
                     pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2)], schema=schema)
                fresh = [i for i, s in enumerate(s1.tolist()) if s not in seen]
                seen.update(s1.tolist())  # copies count once
                parts.append(np.concatenate([h[bounds[i]:bounds[i + 1]] for i in fresh] or [h[:0]]))
                if sum(map(len, parts)) > COUNTED:
                    yield from counted(parts)
                    parts = []
        if parts:
            yield from counted(parts)
    return run, "kind int, doc_id long, n long, s1 long, s2 long"


class Order:
    """The global order: a shingle's hash, or 2^62 plus its place among the frequent ones."""

    def __init__(self, frequent: np.ndarray):
        self.place = np.argsort(frequent, kind="stable")
        self.value = frequent[self.place]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.value & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = h.copy()
        look = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(look):
            at = np.minimum(np.searchsorted(self.value, h[look]), len(self.value) - 1)
            hit = self.value[at] == h[look]
            out[look[hit]] = _TOP + self.place[at[hit]].astype(np.uint64)
        return out


def _ordered(order: Order, bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    value = order(h)
    if (value >= _TOP).any():
        value = value[np.lexsort((value, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))]
    return value


def _prefixes(order, width: int, num: int, den: int):
    """Task: (token, s1, n, pos) of every prefix shingle of every set, once per task."""
    schema = pa.schema([("token", pa.int64()), ("s1", pa.int64()), ("n", pa.int32()),
                        ("pos", pa.int32())])

    def run(batches):
        seen: set[int] = set()
        at = Order(order.value)
        for batch in batches:
            for lo, hi, bounds, h in _sets(batch, width):
                s1, _ = _signature(bounds, h)
                n = np.diff(bounds)
                value = _ordered(at, bounds, h)
                fresh = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(n):
                    key = int(s1[i])
                    fresh[i] = key not in seen
                    seen.add(key)
                take = np.where(fresh, n - -(-num * n // den) + 1, 0)
                total = int(take.sum())
                if not total:
                    continue
                end = np.cumsum(take)
                pos = np.arange(total) - np.repeat(end - take, take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[np.repeat(bounds[:-1], take) + pos].view(np.int64)),
                     pa.array(np.repeat(s1, take)), pa.array(np.repeat(n, take).astype(np.int32)),
                     pa.array(pos.astype(np.int32))], schema=schema)
    return run, "token long, s1 long, n int, pos int"


def bound(n, m, larger, num: int, den: int):
    """Shingles that two linked sets of sizes n and m share in their prefixes, at least.

    They share ``a = ceil(num * (n + m) / (num + den))`` or more. In the larger set at most
    ``ceil(num * larger / den) - 1`` shingles lie behind the prefix, and the common ones come
    in the same order in both sets.
    """
    return -(-num * (n + m) // (num + den)) - -(-num * larger // den) + 1


def _shared(num: int, den: int):
    """Task over rows sorted by token: (token, s1, n, pos, need) of the members of a subtree.

    Length bound: the smaller of two linked sets has ``num / den`` of the larger or more. A row
    stays if some other member meets it. ``need`` is the smallest :func:`bound` among the
    partners that also meet the position bound (no shingle before the first common one is
    shared), or a number no count reaches. Subtrees of more than ``LAGS`` members pass with 1.
    """
    schema = pa.schema([("token", pa.int64()), ("s1", pa.int64()), ("n", pa.int32()),
                        ("pos", pa.int32()), ("need", pa.int32())])

    def joined(batch: pa.RecordBatch, wide: bool = False):
        token, s1, n, pos = (batch.column(c).to_numpy(zero_copy_only=False)
                             for c in ("token", "s1", "n", "pos"))
        n = n.astype(np.int64)
        left = n - pos
        keep = np.full(len(token), wide)
        need = np.full(len(token), 1 if wide else NEVER, np.int64)
        for lag in range(1, LAGS + 1) if not wide else ():
            same = np.flatnonzero(token[lag:] == token[:-lag])
            if not len(same):
                break
            if lag == LAGS:
                large = np.isin(token, token[same])
                keep |= large
                need[large] = 1
                break
            i, j = same, same + lag
            ok = (s1[i] != s1[j]) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
            i, j = i[ok], j[ok]
            keep[i] = keep[j] = True
            ok = np.minimum(left[i], left[j]) * (num + den) >= num * (n[i] + n[j])
            i, j = i[ok], j[ok]
            least = bound(n[i], n[j], np.maximum(n[i], n[j]), num, den)
            np.minimum.at(need, i, least)
            np.minimum.at(need, j, least)
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(need.astype(np.int32))],
                schema=schema).filter(pa.array(keep))

    def run(batches):
        held, wide = None, None  # rows of the last token seen; a token longer than a batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            token = batch.column("token").to_numpy(zero_copy_only=False)
            if wide is not None:
                to = int(np.searchsorted(token, wide, "right"))
                if to:
                    yield from joined(batch.slice(0, to), True)
                    batch, token = batch.slice(to), token[to:]
                if len(token) == 0:
                    continue
                wide = None
            last = int(np.searchsorted(token, token[-1]))
            if last == 0 and len(token) >= LAGS and (
                    held is None or held.column("token")[0].as_py() == int(token[0])):
                wide = int(token[0])
                for part in (held, batch):
                    if part is not None:
                        yield from joined(part, True)
                held = None
                continue
            parts = ([held] if held is not None else []) + [batch]
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            cut = whole.num_rows - (batch.num_rows - last)
            if last == 0 and held is not None and held.column("token")[0].as_py() == int(token[0]):
                cut = 0
            yield from joined(whole.slice(0, cut)) if cut else ()
            held = whole.slice(cut)
        if held is not None:
            yield from joined(held)
    return run, "token long, s1 long, n int, pos int, need int"


def tree(partners: list[np.ndarray]) -> list[int]:
    """The partners in the order of a depth-first visit of their prefix tree."""
    return sorted(range(len(partners)), key=lambda i: partners[i].tolist())


def walk(probe: np.ndarray, partners: list[np.ndarray], num: int = NUM, den: int = DEN,
         order: list[int] | None = None) -> list:
    """Overlap with ``probe`` of every partner that meets the threshold, else None.

    The partners, in global order, are the paths of a prefix tree, visited depth first. A node
    of the tree is a run of shingles that all sets below share; its overlap with the probe is
    counted once. A subtree is left when the overlap so far and the shingles that remain,
    of the probe beyond this node and of the shortest set below, cannot meet the threshold.
    """
    out: list = [None] * len(partners)
    n = len(probe)
    order = tree(partners) if order is None else order
    # (from, to, depth, overlap): sets order[from:to] share their first ``depth`` shingles.
    stack = [(0, len(order), 0, 0)]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, last = partners[order[lo]], partners[order[hi - 1]]
        common = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:common] != last[depth:common])
        to = depth + int(differ[0]) if len(differ) else common
        if to > depth:
            run = first[depth:to]
            at = np.searchsorted(probe, run)
            overlap += int((probe[np.minimum(at, n - 1)] == run).sum()) if n else 0
        ahead = n - int(np.searchsorted(probe, first[to - 1], "right")) if to else n
        # The shortest set below needs the least overlap; none can gain more than ``ahead``.
        shortest = min(len(partners[i]) for i in order[lo:hi])
        best = overlap + ahead
        if best * (num + den) < num * (n + shortest):
            continue
        while lo < hi and len(partners[order[lo]]) == to:
            m = len(partners[order[lo]])
            if overlap * (num + den) >= num * (n + m):
                out[order[lo]] = overlap
            lo += 1
        while lo < hi:  # children: the next shingle
            key = partners[order[lo]][to]
            end = lo + 1
            while end < hi and partners[order[end]][to] == key:
                end += 1
            stack.append((lo, end, to, overlap))
            lo = end
    return out


def _verify(num: int, den: int):
    """Task over rows (a, b, toks_a, toks_b), neighbours in ``a``: (u, v, linked)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_())])

    def arrays(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        return [flat[cut[i]:cut[i + 1]] for i in range(len(column))]

    def run(batches):
        for batch in batches:
            a = batch.column("u").to_numpy(zero_copy_only=False)
            if len(a) == 0:
                continue
            left, right = arrays(batch.column("toks_u")), arrays(batch.column("toks_v"))
            edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
            linked = np.zeros(len(a), bool)
            for lo, hi in zip(edge[:-1], edge[1:]):
                for i, x in enumerate(walk(left[lo], right[lo:hi], num, den)):
                    linked[lo + i] = x is not None
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"),
                                              pa.array(linked)], schema=schema)
    return run, "u long, v long, linked boolean"


def _verify_blocks(num: int, den: int):
    """Task over (ones, others): for every one, a link to each other component among the others."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_())])

    def sets_of(column, i):
        part = column.slice(i, 1).flatten()
        toks = part.field("toks")
        flat = toks.flatten().to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.cumsum(toks.value_lengths().to_numpy())])
        return (part.field("id").to_numpy(), part.field("root").to_numpy(),
                [flat[cut[k]:cut[k + 1]] for k in range(len(part))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, roots, ones = sets_of(batch.column("ones"), i)
                other_ids, other_roots, others = sets_of(batch.column("others"), i)
                order = tree(others)
                out: list[tuple[int, int]] = []
                for k, one in enumerate(ones):
                    met: dict[int, int] = {}
                    for j, overlap in enumerate(walk(one, others, num, den, order)):
                        if overlap is not None and other_roots[j] != roots[k]:
                            met.setdefault(int(other_roots[j]), j)
                    out += [(int(ids[k]), int(other_ids[j])) for j in met.values()]
                if out:
                    u, v = map(pa.array, zip(*out))
                    yield pa.RecordBatch.from_arrays([u, v, pa.array([True] * len(out))],
                                                     schema=schema)
    return run, "u long, v long, linked boolean"


class NgramJoin:
    """The join of one table of documents(doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than
    ``width`` words is one shingle; without words or null it has none and links with nothing.
    Rows that repeat a doc_id are one document: where their texts differ, the components of all its
    texts are one. A row without doc_id has no node and keeps its component null. Other columns
    are ignored.
    """

    def __init__(self, docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH):
        self.num, self.den, self.width = num, den, width
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                F.col("text").cast("string").alias("text"))
        run, schema = _summarise(width)
        summary = written(self.docs.mapInArrow(run, schema), "shingles", by=["kind"])
        self.rows = summary.filter("kind = 0").select("doc_id", "n", "s1", "s2")
        # A doc_id of several sets is no node itself: each of its sets is.
        odd = written(self.rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b"))
            .filter((F.col("a") != F.col("b")) | (F.col("doc_id") >= ODD)).select("doc_id"), "odd")
        self.odd = None if odd.isEmpty() else odd
        nodes = self.rows.withColumn("node", F.col("doc_id"))
        if self.odd is not None:
            nodes = (self.rows.join(self.odd, "doc_id", "left_anti").withColumn("node", F.col("doc_id"))
                     .unionByName(self._odd_rows().select("doc_id", "n", "s1", "s2", "node")))
        self.classes = written(
            nodes.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"))
            .filter("rep IS NOT NULL"), "classes")
        common = (summary.filter("kind = 1").groupBy("s1").agg(F.sum("n").alias("c"))
                  .filter(F.col("c") >= FREQUENT))
        top = common.orderBy(F.desc("c"), "s1").limit(FREQUENT_KEPT)
        # At most FREQUENT_KEPT numbers, rarest first: the tail of the global order.
        rank = top.select("s1").toArrow().column(0).to_numpy()[::-1].copy().view(np.uint64)
        self.order = docs.sparkSession.sparkContext.broadcast(rank)

    def _odd_rows(self) -> DataFrame:
        """(doc_id, n, s1, s2, node) of the rows whose doc_id has several sets."""
        return self.rows.join(self.odd, "doc_id").withColumn("node", _odd_node())

    def _members(self) -> DataFrame:
        """(token, id, n, pos): the sets below each shingle that two or more sets store."""
        run, schema = _prefixes(self.order, self.width, self.num, self.den)
        rows = self.docs.select("text").mapInArrow(run, schema)
        rows = rows.repartition("token").sortWithinPartitions("token", "s1")
        run, schema = _shared(self.num, self.den)
        shared = rows.mapInArrow(run, schema)
        members = written(
            shared.join(self.classes.select("s1", F.col("n").cast("int").alias("n"), "rep"),
                        ["s1", "n"])
            .groupBy("token", F.col("rep").alias("id")).agg(
                F.max("n").alias("n"), F.min("pos").alias("pos"), F.min("need").alias("need")),
            "subtrees")
        # A set that shares fewer prefix shingles than any of its partners needs links with none.
        able = (members.groupBy("id").agg(F.count("*").alias("c"), F.min("need").alias("need"))
                .filter("need <= c").select("id"))
        return members.drop("need").join(able, "id", "left_semi")

    def _tokens(self, members: DataFrame) -> DataFrame:
        """(id, toks): the ordered shingles of every set that is a member of some subtree."""
        order, width = self.order, self.width
        names = ["doc_id", "s1", "s2", "toks"]

        def run(batches):
            at = Order(order.value)
            for batch in batches:
                for lo, hi, bounds, h in _sets(batch, width):
                    value = _ordered(at, bounds, h).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo),
                         *map(pa.array, _signature(bounds, h)),
                         pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                                  pa.array(value))], names=names)

        schema = "doc_id long, s1 long, s2 long, toks array<long>"
        wanted = members.select("id").distinct()
        docs = self.docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        if self.odd is None:
            return docs.mapInArrow(run, schema).select(F.col("doc_id").alias("id"), "toks")
        plain = docs.join(self.odd, "doc_id", "left_anti").mapInArrow(run, schema)
        odd = (self.docs.join(self.odd, "doc_id", "left_semi").mapInArrow(run, schema)
               .withColumn("id", _odd_node()).dropDuplicates(["id"]).join(wanted, "id", "left_semi"))
        return plain.select(F.col("doc_id").alias("id"), "toks").unionByName(odd.select("id", "toks"))

    def _check(self, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        run, schema = _verify(self.num, self.den)
        left = sets.select(F.col("id").alias("u"), F.col("toks").alias("toks_u"))
        right = sets.select(F.col("id").alias("v"), F.col("toks").alias("toks_v"))
        rows = pairs.join(right, "v").join(left, "u").select("u", "v", "toks_u", "toks_v")
        return written(rows.mapInArrow(run, schema), label)

    def _families(self, wide: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v, linked) links among the members of large subtrees, settled block by block.

        Subtrees that share members are one family. Members outside a family's largest
        component, in blocks, meet all members, in blocks: one row a pair of blocks, whatever
        the number of pairs. A member keeps one link to each other component of a block.
        """
        ids = wide.select("id", "root").distinct()
        stars = wide.join(wide.groupBy("token").agg(F.min("id").alias("v")), "token").select(
            F.col("id").alias("u"), "v")
        family = connected(stars).select(F.col("node").alias("id"), F.col("root").alias("family"))
        ids = written(ids.join(family, "id"), "families")
        main = (ids.groupBy("family", "root").agg(F.count("*").alias("c")).groupBy("family")
                .agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"),
                     (F.sum("c") - F.max("c")).alias("loose")).filter("loose > 0"))
        at = ids.join(main, "family")
        place = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / HELD)).cast("int")
        right = at.select("family", place("all").alias("b"), "id", "root")
        left = at.filter("root <> main").select("family", place("loose").alias("a"), "id", "root")
        rows = lambda df, b, name: (
            df.join(sets, "id").groupBy("family", b).agg(
                F.collect_list(F.struct("id", "root", "toks")).alias(name)))
        meet = (left.select("family", "a").distinct()
                .join(right.select("family", "b").distinct(), "family"))
        both = meet.join(rows(left, "a", "ones"), ["family", "a"]).join(
            rows(right, "b", "others"), ["family", "b"])
        run, schema = _verify_blocks(self.num, self.den)
        return written(both.select("ones", "others").mapInArrow(run, schema), "family_links")

    def links(self) -> DataFrame:
        """(u, v) links between representatives that connect all that any link connects."""
        num, den = self.num, self.den
        members = written(self._members(), "members")
        sets = written(self._tokens(members), "sets")
        admit = (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)
        least = (F.ceil(F.lit(num) * (F.col("n") + F.col("m")) / F.lit(num + den))
                 - F.ceil(F.lit(num) * F.greatest("n", "m") / F.lit(den)) + 1)
        done = label = None
        r = 0
        while r <= len(PARTNERS):
            at = members
            if label is not None:
                at = (members.join(label.select(F.col("node").alias("id"), "root"), "id", "left")
                      .withColumn("root", F.coalesce("root", "id")))
                spread = (at.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                          .filter("lo < hi").select("token"))
                at = at.join(spread, "token")
            else:
                at = at.withColumn("root", F.col("id"))
            if r < len(PARTNERS):
                # A few partners a set: members that a hash picks in the most of its subtrees.
                pick = at.groupBy("token").agg(F.array(*(
                    F.struct(F.min_by(F.struct("id", "n", "root"),
                                      F.xxhash64("id", F.lit(r), F.lit(k))).alias("p"),
                             F.lit(k).alias("k")) for k in range(PARTNERS[r]))).alias("ps"))
                pairs = (at.join(pick, "token").withColumn("q", F.explode("ps"))
                         .withColumn("p", F.col("q.p")).filter("root <> p.root")
                         .withColumn("m", F.col("p.n")).filter(admit)
                         .groupBy("id", F.col("p.id").alias("other"), F.col("q.k").alias("k")).agg(
                             F.count("*").alias("c"), F.first(least).alias("need"))
                         .filter("c >= need")
                         .groupBy("id", "k").agg(F.max_by("other", F.struct("c", "other")).alias("other")))
                pairs = pairs.select(F.greatest("other", "id").alias("u"),
                                     F.least("other", "id").alias("v")).distinct()
            else:
                at = at.join(at.groupBy("token").agg(F.count("*").alias("size")), "token")
                wide = written(at.filter(F.col("size") > LAGS), "wide")
                at = at.filter(F.col("size") <= LAGS)
                far = at.select("token", F.col("id").alias("v"), F.col("root").alias("root_v"),
                                F.col("n").alias("m"), F.col("pos").alias("pos_v"))
                pairs = (at.join(far, "token").filter("root < root_v").filter(admit)
                         .groupBy(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).agg(
                             F.count("*").alias("c"), F.first(least).alias("need"),
                             F.max(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos_v"))
                                   * (num + den) >= F.lit(num) * (F.col("n") + F.col("m")))
                             .alias("near"))
                         .filter("near AND c >= need").select("u", "v"))
            if done is not None:
                pairs = pairs.join(done.select("u", "v"), ["u", "v"], "left_anti")
            found = self._check(pairs, sets, f"round{r}")
            if r >= len(PARTNERS) and not wide.isEmpty():
                found = found.unionByName(self._families(wide, sets))
            done = found if done is None else done.unionByName(found)
            idle = found.isEmpty()
            last = r >= len(PARTNERS)
            r = len(PARTNERS) if idle and not last else r + 1
            if last:
                label = connected(done.filter("linked").select("u", "v"))
            elif not idle:
                # Only spares later rounds work: part of each component will do.
                label = connected(done.filter("linked").select("u", "v"), rounds=2)
        self.label = label
        return done.filter("linked").select("u", "v")

    def _homes(self) -> DataFrame:
        """(s1, s2, n, root): the smallest node that links reach from each class."""
        return (self.classes.join(self.label, self.classes["rep"] == self.label["node"], "left")
                .select("s1", "s2", "n", F.coalesce("root", "rep").alias("root")))

    def components(self) -> DataFrame:
        """A row per row of the documents: doc_id, n_shingles, component_id."""
        self.links()
        key = ["s1", "s2", "n"]
        # A root is the smallest representative, and a representative the smallest doc_id.
        home = self._homes().withColumn("component_id", F.col("root"))
        if self.odd is not None:
            # The roots of one document's texts are one, and its doc_id counts where its node does not.
            at = written(self._odd_rows().join(home, key).select("doc_id", "root"), "odd_roots")
            star = at.join(at.groupBy("doc_id").agg(F.min("root").alias("v")), "doc_id").select(
                F.col("root").alias("u"), "v")
            joined = connected(star).select(F.col("node").alias("root"), F.col("root").alias("last"))
            least = (at.join(joined, "root", "left").withColumn("last", F.coalesce("last", "root"))
                     .groupBy("last").agg(F.min("doc_id").alias("low")))
            last = (at.select("root").distinct().join(joined, "root", "left")
                    .withColumn("last", F.coalesce("last", "root")).join(least, "last")
                    .withColumn("low", F.when(F.col("last") < ODD, F.least("low", "last"))
                                .otherwise(F.col("low"))).select("root", "low"))
            home = (home.join(last, "root", "left")
                    .withColumn("component_id", F.coalesce("low", "root")))
        home = home.select(*key, "component_id")
        found = self.rows.join(home, key, "left")
        if self.odd is not None:
            # A row without shingles goes with the other texts of its document.
            low = (found.join(self.odd, "doc_id").groupBy("doc_id")
                   .agg(F.min("component_id").alias("low")))
            found = found.join(low, "doc_id", "left").withColumn(
                "component_id", F.coalesce("component_id", "low"))
        return found.select("doc_id", F.col("n").alias("n_shingles"),
                            F.when(F.col("doc_id").isNotNull(),
                                   F.coalesce("component_id", "doc_id")).alias("component_id"))

    def spare(self) -> tuple[DataFrame, DataFrame | None]:
        """Rows that another stands for: by doc_id, and by (doc_id, s1, s2) where that has several sets."""
        self.links()
        home = self._homes()
        rows = self.rows if self.odd is None else self.rows.join(self.odd, "doc_id", "left_anti")
        plain = (rows.join(home, ["s1", "s2", "n"]).filter("doc_id <> root").select("doc_id").distinct())
        if self.odd is None:
            return plain, None
        odd = (self._odd_rows().join(home, ["s1", "s2", "n"]).filter("node <> root")
               .select("doc_id", "s1", "s2").distinct())
        return plain, odd


def _odd_node():
    """Node of a set of a document that has several."""
    return F.lit(ODD) + F.pmod(F.xxhash64("doc_id", "s1", "s2"), F.lit(ODD))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one document of each family of linked texts: that of smallest doc_id.

    Rows of that doc_id and text stay together; rows without doc_id or without words all stay. Of a
    doc_id that has several texts, each text is a document of its own here, so that no text is lost
    because another one of its doc_id is a copy.
    """
    join = NgramJoin(docs, **options)
    rest, odd = join.spare()
    names = docs.columns
    if odd is None:
        return docs.join(rest, "doc_id", "left_anti").select(names)
    width = join.width
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.struct(*map(F.col, names)).alias("_row"))
    schema = packed.select("doc_id", "_row").schema.add("s1", "long").add("s2", "long")

    def run(batches):
        for batch in batches:
            for lo, hi, bounds, h in _sets(batch, width):
                s1, s2 = _signature(bounds, h)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "_row")),
                     pa.array(s1), pa.array(s2)], names=["doc_id", "_row", "s1", "s2"])

    plain = packed.join(join.odd, "doc_id", "left_anti").join(rest, "doc_id", "left_anti")
    several = (packed.join(join.odd, "doc_id", "left_semi").mapInArrow(run, schema)
               .join(odd, ["doc_id", "s1", "s2"], "left_anti"))
    return plain.select("_row").unionByName(several.select("_row")).select(
        *(F.col("_row")[c].alias(c) for c in names))
