"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over whole texts.

Terms are the words of a text and their prefixes of 4 to 6 bytes (so that an inflected word meets
its stem; it counts less than a word). All terms of a text count. Document frequencies are those
among the examples, a bounded set of labelled rows; the weight of a term is its inverse document
frequency times its shrunken log odds between toxic and clean examples (delta TF-IDF), plus a floor
that no term falls below. Every example is indexed, toxic or clean.

The index is block-max: examples whose strongest term is the same lie together, in blocks, and of
each common term the largest weight in a block is known. The postings of the other terms are summed
as they are. One product bounds the cosines of a batch of queries with every block; blocks are
visited in falling order of their bounds, several queries at once, until a query's next bound is below
its k-th cosine. The votes of the k nearest, weighted by cosine, become a probability by a logistic
curve fitted on leave-one-out votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from plateauscope.llm import tokens as T
from plateauscope.llm.tables import written
from plateauscope.llm.training import held_out, training_rows

EXAMPLES = 2048  # labelled rows learnt from, at most
EXAMPLE_CHARS = 100_000  # longer labelled rows are not learnt from
NEIGHBOURS = 15
BLOCK = 64  # examples of a block
COMMON = 0.1  # share of the examples above which a term is common
BATCH = 128  # queries searched at once
POSTINGS = 1 << 20  # postings of rare terms that are held at once, if one query has no more
SLICE_BYTES = 8 << 20  # text of a batch that is scored at once, if one text has no more
CUT = 0.7
PRIOR = 0.5  # weight of the base rate among the votes
PREFIX = 0.25  # weight of a prefix against that of a word
SHRINK = 4.0  # examples at the base rate that every term is taken to have besides its own
FLOOR = 0.05  # added to the log odds of every term
_PREFIXES = (4, 5, 6)

# Words: ASCII letters and digits and every byte of a character beyond ASCII.
_GAP = np.ones(128, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_GAP = np.concatenate([_GAP, np.zeros(128, bool)])


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every occurrence of a term; the hash of a prefix is odd."""
    row, word, start, end = T.words(data, offsets, _GAP)
    rows, terms = [row], [word & ~np.uint64(1)]
    if len(start):
        up, down = T._powers(len(data) + 1)
        total = np.cumsum(T._BYTE[T.LOWER[data]] * up[:len(data)], dtype=np.uint64)
        before = np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0))
        for size in _PREFIXES:
            long = np.flatnonzero(end - start > size)
            s = start[long]
            rows.append(row[long])
            terms.append(T.mix((total[s + size - 1] - before[long]) * down[s]
                               + np.uint64(size * 0x9E3779B1)) | np.uint64(1))
    return np.concatenate(rows), np.concatenate(terms)


def _counted(row: np.ndarray, term: np.ndarray):
    """(distinct terms; row, place among them and occurrences, sorted by row and place)."""
    values, place = np.unique(term, return_inverse=True)
    size = max(1, len(values))
    key, n = np.unique(row * size + place, return_counts=True)
    return values, key // size, key % size, n


def _long(data: np.ndarray):
    """As :func:`_counted` for one long text, read in windows that end between words."""
    values, n, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    while at < len(data):
        to = at + T.CHUNK_BYTES
        gaps = np.flatnonzero(_GAP[data[at:to]])
        if to < len(data) and len(gaps):
            to = at + int(gaps[-1]) + 1
        else:  # the text's end, or a word longer than a window
            while to < len(data) and not len(gaps := np.flatnonzero(_GAP[data[to:to + T.CHUNK_BYTES]])):
                to += T.CHUNK_BYTES
            to += int(gaps[0]) + 1 if to < len(data) else 0
        part = data[at:to]
        more, _, _, k = _counted(*_terms(part, np.array([0, len(part)])))
        values, place = np.unique(np.concatenate([values, more]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, k])).astype(np.int64)
        at = to
    return values, np.zeros(len(values), np.int64), np.arange(len(values)), n


def _ranges(column: pa.Array) -> Iterator[tuple]:
    """(first row, end) of ranges of texts, and their terms as :func:`_counted` has them."""
    data, offsets = T.utf8(column)
    for lo, hi in T.chunks(offsets):
        part = data[offsets[lo]:offsets[hi]]
        if len(part) > T.CHUNK_BYTES:
            yield lo, hi, *_long(part)
        else:
            yield lo, hi, *_counted(*_terms(part, offsets[lo:hi + 1] - offsets[lo]))


def term_weights(terms: np.ndarray, df: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int):
    """Weight of terms that ``df`` of ``n`` examples hold, ``toxic`` of them toxic."""
    kind = np.where(terms & np.uint64(1), PREFIX, 1.0)
    idf = np.log((1 + n) / (1 + df)) + 1
    odds = np.zeros(len(terms))
    if 0 < n_toxic < n:
        a, b = SHRINK * n_toxic / n, SHRINK * (n - n_toxic) / n
        odds = np.abs(np.log((toxic + a) / (n_toxic + a))
                      - np.log((df - toxic + b) / (n - n_toxic + b)))
    return kind * idf * (odds + FLOOR)


def learnt(ids: np.ndarray, y: np.ndarray, size: np.ndarray, term: np.ndarray, n: np.ndarray) -> dict:
    """The index of examples as arrays of the least width: they are broadcast.

    ``size`` terms an example, given by ``term`` and their counts ``n``.
    """
    hashes, place = np.unique(term, return_inverse=True)
    of = np.repeat(np.arange(len(ids)), size)
    df = np.bincount(place, minlength=len(hashes))
    toxic = np.bincount(place, y[of], len(hashes)).astype(np.int64)
    weight = term_weights(hashes, df, toxic, len(ids), int(y.sum()))
    w = (1 + np.log(n)) * weight[place]
    norm = np.sqrt(np.bincount(of, w * w, len(ids)))
    # Examples in order of their strongest term; terms from rarest to most common.
    strongest = np.zeros(len(ids), np.int64)
    by_weight = np.lexsort((-place, w, of))
    strongest[of[by_weight]] = place[by_weight]  # the last of an example wins
    order = np.lexsort((ids, strongest))
    at = np.empty(len(ids), np.int64)
    at[order] = np.arange(len(ids))
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(hashes))
    posting = np.lexsort((at[of], rank[place]))
    return {"hashes": hashes, "rank": rank.astype(np.int32), "df": df.astype(np.int32),
            "toxic": toxic.astype(np.int32), "ids": ids[order], "y": y[order], "norm": norm[order],
            "example": at[of][posting].astype(np.min_scalar_type(max(1, len(ids)))),
            "n": n[posting].astype(np.min_scalar_type(int(n.max(initial=1))))}


class Index:
    """The examples' terms in blocks, and the k nearest of a query."""

    def __init__(self, parts: dict):
        self.hashes, self.rank = parts["hashes"], parts["rank"]
        self.ids, self.y = parts["ids"], parts["y"]
        n = len(self.ids)
        self.weights = term_weights(self.hashes, parts["df"].astype(np.int64),
                                    parts["toxic"].astype(np.int64), n, int(self.y.sum()))
        self.unknown = term_weights(np.array([0, 1], np.uint64), *np.zeros((2, 2)), n, int(self.y.sum()))
        often = np.empty(len(self.hashes), np.int64)
        often[self.rank] = parts["df"]
        self.start = np.concatenate([[0], np.cumsum(often)])
        self.example = parts["example"].astype(np.int64)
        by_rank = np.empty(len(self.hashes))
        by_rank[self.rank] = self.weights
        self.weight = ((1 + np.log(parts["n"], dtype=float)) * np.repeat(by_rank, often)
                       / parts["norm"][self.example])
        self.common = int(np.searchsorted(often, COMMON * n, "right"))
        self.blocks = -(-n // BLOCK)
        at = slice(self.start[self.common], None)
        dense = np.zeros((len(often) - self.common, self.blocks * BLOCK))
        dense[np.repeat(np.arange(len(dense)), often[self.common:]), self.example[at]] = self.weight[at]
        dense = dense.reshape(len(dense), self.blocks, BLOCK)
        self.most = dense.max(2, initial=0)  # of every common term and block
        self.dense = np.ascontiguousarray(dense.transpose(1, 0, 2))
        self.asked = self.looked = 0  # blocks of all queries, and those visited

    def weighted(self, rows: int, values, row, place, n):
        """(bounds, term, weight): unit vectors of ``rows`` texts without the terms of no example."""
        at = np.minimum(np.searchsorted(self.hashes, values), max(0, len(self.hashes) - 1))
        held = self.hashes[at] == values if len(self.hashes) else np.zeros(len(values), bool)
        w = self.unknown[(values & np.uint64(1)).astype(np.int64)]
        w[held] = self.weights[at[held]]
        term = np.full(len(values), -1)
        term[held] = self.rank[at[held]]
        w = (1 + np.log(n)) * w[place]
        norm = np.sqrt(np.bincount(row, w * w, rows))
        keep = term[place] >= 0
        row, term, w = row[keep], term[place][keep], w[keep]
        return np.searchsorted(row, np.arange(rows + 1)), term, w / norm[row]

    def _dots(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int,
              without: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of ``m`` queries with every example of the blocks that may hold the k nearest,
        and the k-th of each query (0 where it has fewer)."""
        size = self.blocks * BLOCK
        common = term >= self.common
        q = np.zeros((m, len(self.most)))
        q[query[common], term[common] - self.common] = weight[common]
        query, term, weight = query[~common], term[~common], weight[~common]
        count = self.start[term + 1] - self.start[term]
        # Whole queries at a time, so that a sum does not depend on the others of its batch.
        to = np.searchsorted(query, np.arange(m + 1))
        held = np.concatenate([[0], np.cumsum(count)])[to]
        rare = np.zeros((m, size))
        for lo, hi in T.chunks(held, POSTINGS):
            part = slice(to[lo], to[hi])
            n, first = count[part], self.start[term[part]]
            at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            rare[lo:hi] = np.bincount(np.repeat((query[part] - lo) * size, n) + self.example[at],
                                      np.repeat(weight[part], n) * self.weight[at],
                                      (hi - lo) * size).reshape(hi - lo, size)
        if without is not None:
            rare[np.arange(m), without] = -np.inf
        bound = q @ self.most + rare.reshape(m, self.blocks, BLOCK).max(2) + 1e-9
        order = np.argsort(-bound, axis=1, kind="stable")
        falling = np.take_along_axis(bound, order, 1)
        dots, least, at, wide = np.zeros((m, size)), np.full(m, 2e-9), 0, 4
        self.asked += m * self.blocks
        while at < self.blocks:
            who, which = np.nonzero(falling[:, at:at + wide] >= least[:, None] - 1e-9)
            if not len(who):
                break
            which = order[who, which + at]
            self.looked += len(who)
            by_block = np.argsort(which, kind="stable")
            for some in np.split(by_block, np.flatnonzero(np.diff(which[by_block])) + 1):
                b = int(which[some[0]])
                here = slice(b * BLOCK, (b + 1) * BLOCK)
                dots[who[some], here] = q[who[some]] @ self.dense[b] + rare[who[some], here]
            if size > k:
                least = np.maximum(np.partition(dots, size - k, axis=1)[:, size - k], 2e-9)
            at, wide = at + wide, 3 * wide
        return dots, least

    def nearest(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int,
                skip: list | None = None):
        """(row, examples, cosines) of the k nearest of positive cosine of every row with terms.

        Row ``i`` has the terms from ``bounds[i]`` to ``bounds[i + 1]``. Ties go by smaller id.
        ``skip`` has the example that each row leaves out.
        """
        rows = np.flatnonzero(np.diff(bounds)) if len(self.ids) else []
        place = {d: i for i, d in enumerate(self.ids.tolist())} if skip is not None else None
        for lo in range(0, len(rows), BATCH):
            some = rows[lo:lo + BATCH]
            count = bounds[some + 1] - bounds[some]
            at = (np.arange(int(count.sum()))
                  + np.repeat(bounds[some] - (np.cumsum(count) - count), count))
            dots, kth = self._dots(np.repeat(np.arange(len(some)), count), term[at], weight[at], len(some),
                                   k, [place[skip[i]] for i in some] if skip is not None else None)
            for i, dot, least in zip(some, dots, kth - 1e-9):
                best = np.flatnonzero((dot >= least) & (dot > 1e-12))
                cosine = dot[best]
                top = np.lexsort((self.ids[best], -np.round(cosine, 12)))[:k]
                yield i, best[top], cosine[top]


def vote(y: np.ndarray, cosine: np.ndarray, base: float) -> float:
    """Toxic share of the neighbours, weighted by cosine, with the base rate as one more voice."""
    return (float(cosine @ y) + PRIOR * base) / (float(cosine.sum()) + PRIOR)


def fit_curve(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the logit of a vote to a probability."""
    x = np.log(votes) - np.log1p(-votes)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps; a ridge keeps separable votes finite
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * (w[0] - 1), (p - y).sum() + 0.1 * w[1]])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class Toxicity:
    """Examples, index and curve learnt from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Examples are at most ``examples`` labelled rows that are not held out, those of smallest id hash,
    of at most ``EXAMPLE_CHARS`` code points. A text that is null, empty or shares no term with an
    example has no neighbours; its vote is the base rate of the examples. Without labelled rows the base rate is 0
    and every score is the same. Rows that repeat a doc_id, or have none, are scored one by one;
    equal texts of a slice are searched once. Labels, lang, source and doc_id are no part of a
    score. Only the examples' terms reach the driver and are broadcast.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES,
                 neighbours: int = NEIGHBOURS, cut: float = CUT):
        self.k, self.cut = neighbours, cut
        short = docs.filter(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) <= EXAMPLE_CHARS)
        rows = written(training_rows(short, labels, "toxic", examples), "toxic_examples")
        parts = self._learnt(rows)
        toxic = int(parts["y"].sum())
        self.base = toxic / max(1, len(parts["y"]))
        self.index = docs.sparkSession.sparkContext.broadcast(parts)
        self.curve = (1.0, 0.0)
        if 0 < toxic < len(parts["y"]):
            at = self._scored(rows.select("doc_id", "text", "y"), leave_out=True)
            got = at.select("raw", "y").collect()  # at most ``examples`` rows
            self.curve = fit_curve(np.array([r["raw"] for r in got]),
                                   np.array([r["y"] for r in got], float))

    @staticmethod
    def _learnt(rows: DataFrame) -> dict:
        def run(batches):
            for batch in batches:
                for lo, hi, values, row, place, n in _ranges(batch.column("text")):
                    at = np.searchsorted(row, np.arange(hi - lo + 1))
                    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo),
                         cut(values[place]), cut(n.astype(np.int32))],
                        names=["doc_id", "y", "t", "n"])

        # At most ``examples`` rows of bounded length, a partition at a time.
        ids, y, term, n = [], [], [], []
        for r in rows.mapInArrow(run, "doc_id long, y int, t binary, n binary").toLocalIterator():
            ids.append(r["doc_id"])
            y.append(r["y"])
            term.append(np.frombuffer(r["t"], np.uint64))
            n.append(np.frombuffer(r["n"], np.int32))
        size = np.array([len(t) for t in term], np.int64)
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return learnt(np.array(ids, np.int64), np.array(y, float), size,
                      joined(term, np.uint64), joined(n, np.int32))

    def _scored(self, rows: DataFrame, leave_out: bool = False, with_text: bool = False) -> DataFrame:
        index, k, base = self.index, self.k, self.base
        keep = [c for c in rows.columns if with_text or c != "text"]
        schema = (rows.select(*keep).schema.add("raw", "double")
                  .add("evidence", ArrayType(LongType())).add("cosines", ArrayType(DoubleType())))

        def run(batches):
            ix = Index(index.value)
            for batch in batches:
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                for first, end in T.chunks(bounds, SLICE_BYTES):
                    yield scored(ix, batch.slice(first, end - first))

        def scored(ix, batch):
            texts, at = batch.column("text").fill_null(""), None
            ids = batch.column("doc_id").to_pylist() if leave_out else None
            if not leave_out:
                coded = texts.dictionary_encode()
                texts, at = coded.dictionary, coded.indices
            raw = np.full(len(texts), base)
            near, sims = [[]] * len(texts), [[]] * len(texts)
            for lo, hi, values, row, place, n in _ranges(texts):
                found = ix.nearest(*ix.weighted(hi - lo, values, row, place, n), k,
                                   ids[lo:hi] if leave_out else None)
                for i, best, cosine in found:
                    raw[lo + i] = vote(ix.y[best], cosine, base)
                    near[lo + i], sims[lo + i] = ix.ids[best].tolist(), cosine.tolist()
            out = [pa.array(np.clip(raw, 1e-6, 1 - 1e-6)), pa.array(near, pa.list_(pa.int64())),
                   pa.array(sims, pa.list_(pa.float64()))]
            if at is not None:
                out = [x.take(at) for x in out]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out],
                                              names=[*keep, "raw", "evidence", "cosines"])

        return rows.mapInArrow(run, schema)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted, evidence, cosines) of every row."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("string").alias("text"))
        slope, offset = self.curve
        logit = F.log("raw") - F.log1p(-F.col("raw"))
        return (self._scored(rows)
                .withColumn("score", 1 / (1 + F.exp(-(logit * slope + offset))))
                .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= self.cut).cast("int").alias("predicted"),
                        "evidence", "cosines"))

    def accepted(self, docs: DataFrame) -> DataFrame:
        """``docs``, all columns, without the rows whose text is scored ``cut`` or more."""
        names = docs.columns
        slope, offset = self.curve
        others = [c for c in names if c.lower() != "text"]
        rows = self._scored(docs.select(F.struct(*map(F.col, others)).alias("_row"), "text"), with_text=True)
        logit = F.log("raw") - F.log1p(-F.col("raw"))
        kept = rows.filter(1 / (1 + F.exp(-(logit * slope + offset))) < self.cut)
        return kept.select(*((F.col("_row")[c] if c in others else F.col("text")).alias(c) for c in names))
