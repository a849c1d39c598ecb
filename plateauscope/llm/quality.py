"""Document quality: a linear-chain conditional random field over the lines of a text.

Every line gets binned features of its own and of its neighbours. The field has two states,
good and bad, and learns line weights and transitions from a bounded set of labelled
documents, whose lines carry the document's label. The quality of a document is the mean of
its lines' forward-backward marginals of the good state, weighted by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateauscope.llm import tokens as T
from plateauscope.llm.training import held_out, training_rows

EXAMPLES = 4_000  # labelled documents learnt from, at most
BINS = 8
STEPS = 150
RIDGE = 1e-3
MEASURES = ("upper", "symbol", "mark", "digit", "space", "repeat", "echo", "distinct", "width",
            "size", "same")
NEIGHBOURS = ("upper", "symbol", "repeat", "distinct", "size")


def _class_table() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: letters and everything beyond ASCII
    kind[65:91] = 1
    kind[list(b"#$%&*@^_=<>|~\\/{}[]")] = 2
    kind[list(b"!?")] = 3
    kind[48:58] = 4
    kind[[0x20, *range(0x09, 0x0E)]] = 5
    return kind


_KIND = _class_table()


def measures(data: np.ndarray, offsets: np.ndarray):
    """(row, length in bytes, measures) of every line that is not blank, in order."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[1:] |= data == 10
    at = np.flatnonzero(first[:n])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(MEASURES)))
    size = np.diff(np.append(at, n)).astype(float)
    kind = _KIND[data]
    share = {k: np.add.reduceat((kind == c).astype(float), at) / size
             for k, c in (("upper", 1), ("symbol", 2), ("mark", 3), ("digit", 4), ("space", 5))}
    _, word, start, end = T.words(data, offsets)
    line = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(line, minlength=len(at))
    some = np.maximum(n_words, 1)
    echo = {}
    for name, lag in (("repeat", 1), ("echo", 2)):
        hit = (word[lag:] == word[:-lag]) & (line[lag:] == line[:-lag])
        echo[name] = np.bincount(line[lag:][hit], minlength=len(at)) / some
    order = np.lexsort((word, line))
    l, w = line[order], word[order]
    new = np.ones(len(l), bool)
    new[1:] = (l[1:] != l[:-1]) | (w[1:] != w[:-1])
    distinct = np.bincount(l[new], minlength=len(at)) / some
    width = np.bincount(line, end - start, len(at)) / some
    # A line that the same text holds more than once, by the sum of its word hashes.
    row = np.searchsorted(offsets, at, "right") - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word, dtype=np.uint64)])
    upto = np.concatenate([[0], np.cumsum(n_words)])
    mark = T.mix((total[upto[1:]] - total[upto[:-1]]) ^ T.mix(row.astype(np.uint64)))
    _, place, times = np.unique(mark, return_inverse=True, return_counts=True)
    out = np.stack([share["upper"], share["symbol"], share["mark"], share["digit"], share["space"],
                    echo["repeat"], echo["echo"], distinct, width, np.log1p(n_words),
                    (times[place] > 1).astype(float)], axis=1)
    keep = n_words > 0
    return row[keep], size[keep].astype(np.int64), out[keep]


class Field:
    """Weights of a two-state chain: bins of measures, one weight each, and transitions."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges  # (measures, BINS - 1)
        wide = len(MEASURES) + 2 * (len(NEIGHBOURS) + 1)
        self.weight = np.zeros(wide * BINS)
        self.move = np.zeros((2, 2))

    def features(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of the active weights of every line: own, previous and next line."""
        bins = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)],
                        axis=1)
        near = [MEASURES.index(n) for n in NEIGHBOURS]
        columns = [bins]
        for shift in (1, -1):
            other = np.roll(bins[:, near], shift, axis=0)
            there = np.roll(row, shift) == row
            there[0 if shift == 1 else -1] = False
            other[~there] = 0
            columns += [other, there.astype(int)[:, None]]
        place = np.concatenate(columns, axis=1)
        return place + np.arange(place.shape[1]) * BINS

    def marginals(self, row: np.ndarray, score: np.ndarray):
        """Probability of good for every line; and, for learning, of the moves and log Z.

        Texts run side by side: step t handles line t of every text that has one.
        """
        n = len(row)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        count = np.diff(np.append(first, n))
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        emit = np.exp(np.clip(np.stack([-score / 2, score / 2], axis=1), -30, 30))
        move = np.exp(self.move)
        alpha, scale, beta = np.zeros((n, 2)), np.ones(n), np.ones((n, 2))
        live = [first[:int(np.searchsorted(-count, -t))] for t in range(int(count[0]) + 1)]
        for t in range(int(count[0])):
            i = live[t] + t
            a = emit[i] if t == 0 else (alpha[i - 1] @ move) * emit[i]
            scale[i] = a.sum(axis=1)
            alpha[i] = a / scale[i, None]
        for t in range(int(count[0]) - 2, -1, -1):
            i = live[t + 1] + t
            beta[i] = ((emit[i + 1] * beta[i + 1]) @ move.T) / scale[i + 1, None]
        good = (alpha * beta)[:, 1] / (alpha * beta).sum(axis=1)
        inner = np.flatnonzero(np.concatenate([row[1:] == row[:-1], [False]]))
        pair = (alpha[inner, :, None] * move[None] * (emit[inner + 1] * beta[inner + 1])[:, None, :]
                / scale[inner + 1, None, None])
        return good, pair.sum(axis=0), float(np.log(scale).sum())

    def fit(self, row: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> "Field":
        """Maximum conditional likelihood by Adam over all examples; y is 0 or 1 per line."""
        place = self.features(row, x)
        inner = np.flatnonzero(row[1:] == row[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
        m = [np.zeros_like(self.weight), np.zeros_like(self.move)]
        v = [np.zeros_like(self.weight), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            good, moves, _ = self.marginals(row, self.weight[place].sum(axis=1))
            # Each text weighs the same, however many lines it has.
            g = np.bincount(place.ravel(), np.repeat(y - good, place.shape[1]), len(self.weight))
            grads = [g / len(row) - RIDGE * self.weight, (seen - moves) / len(row) - RIDGE * self.move]
            for k, (p, grad) in enumerate(zip((self.weight, self.move), grads)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p += 0.2 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def quality(self, row: np.ndarray, size: np.ndarray, x: np.ndarray, n_rows: int,
                empty: float) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; ``empty`` for a row without lines."""
        out = np.full(n_rows, empty)
        if len(row):
            good, _, _ = self.marginals(row, self.weight[self.features(row, x)].sum(axis=1))
            weight = np.bincount(row, size, n_rows)
            has = weight > 0
            out[has] = (np.bincount(row, size * good, n_rows)[has] / weight[has])
        return np.clip(out, 0.0, 1.0)


class Quality:
    """The field learnt from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    A null text is an empty one. A text without a word scores the share of good labels among
    the examples (0.5 if there are none). Rows that repeat a doc_id, or have none, are scored one
    by one. Labels, lang, source and doc_id are no part of a score.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES):
        rows = training_rows(docs, labels, "quality", examples)

        def run(batches):
            for batch in batches:
                data, offsets = T.utf8(batch.column("text"))
                for lo, hi in T.chunks(offsets):
                    base = offsets[lo]
                    row, _, x = measures(data[base:offsets[hi]], offsets[lo:hi + 1] - base)
                    bounds = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo),
                         batch.column("y").slice(lo, hi - lo),
                         pa.ListArray.from_arrays(pa.array(bounds * x.shape[1]),
                                                  pa.array(x.ravel()))],
                        names=["doc_id", "y", "x"])

        # A small table of at most ``examples`` documents' line measures.
        got = (rows.mapInArrow(run, "doc_id long, y int, x array<double>")
               .orderBy("doc_id").toArrow())
        label = got.column("y").to_numpy().astype(float)
        self.empty = float(label.mean()) if len(label) else 0.5
        parts = [np.array(v, float).reshape(-1, len(MEASURES)) for v in got.column("x").to_pylist()]
        x = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)))
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        cuts = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = (np.quantile(x, cuts, axis=0).T if len(x)
                 else np.zeros((len(MEASURES), BINS - 1)))
        field = Field(edges)
        if len(x):
            field.fit(row, x, label[row])
        self.field = docs.sparkSession.sparkContext.broadcast(vars(field))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every row."""
        field, empty = self.field, self.empty

        def run(batches):
            learnt = Field(field.value["edges"])
            learnt.__dict__.update(field.value)
            for batch in batches:
                data, offsets = T.utf8(batch.column("text"))
                for lo, hi in T.chunks(offsets):
                    base = offsets[lo]
                    row, size, x = measures(data[base:offsets[hi]], offsets[lo:hi + 1] - base)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo),
                         pa.array(learnt.quality(row, size, x, hi - lo, empty))],
                        names=["doc_id", "score"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("string").alias("text"))
        return (rows.mapInArrow(run, "doc_id long, score double")
                .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted")))
