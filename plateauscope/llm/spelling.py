"""Spelling variants: words one edit apart, found by search schemes over FM-indexes.

Two words one edit apart share one half of either exactly: the edit lies in the other. So a word is
dealt to the tasks once for each half it can share (prefixes and suffixes of about half its length),
and a task holds the complete groups of some halves. It indexes their words, joined by delimiters, in
both directions: the index of the reversed vocabulary extends a match to the right, that of the
vocabulary itself to the left. A search matches one half exactly from its delimiter inwards, goes on
across the other half and allows one error there, and ends at the other delimiter. A match is an
interval of suffix ranks; all words of a block are searched at once, a step being two look-ups of
ranks per interval (NumPy), and an interval branches into the letters that occur before it, never
into its words. No pairs are formed within a group.

A pair that shares both halves' sides (an edit in the middle) counts where it shares the prefix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateauscope.llm.tables import written

LEAST_LENGTH, LEAST_COUNT = 5, 3
FACTOR = 2  # a form is at least so many times as frequent as the word
COUNTED = 200_000  # distinct words a task counts before it hands them on
BLOCK = 40_000  # words of one index; a half that more words share is dealt in blocks
CELLS = 4_000_000  # letters of the words searched at once


# --- words and their counts -------------------------------------------------------------------

def count_words(docs: DataFrame, least: int = 1, damage: int | None = None) -> DataFrame:
    """(word, n): runs of Latin-1 letters of all texts, A-Z lower-cased, counted over all documents.

    Runs of fewer than ``least`` code points are not counted. With ``damage`` a run whose crc32(``doc_id:run``) it divides loses the code point at that crc
    modulo the length, as planted misspellings. A null text has no words; a null doc_id is an empty
    text. Counts are combined per task before they are shuffled.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches):
        lowered: dict[str, tuple[bytes, bytes]] = {}  # Latin-1 and UTF-8 of a run in lower case
        counts: dict[bytes, int] = {}

        def full():
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())],
                                             schema=schema)
            counts.clear()
            lowered.clear()
            return out

        parts = (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500))
        for part in parts:
            for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                prefix = zlib.crc32(f"{i or ''}:".encode())
                for raw, n in Counter(pattern.findall(text or "")).items():
                    try:
                        low, utf8 = lowered[raw]
                    except KeyError:
                        low = raw.encode("latin-1").lower()  # bytes fold A-Z alone
                        utf8 = low.decode("latin-1").encode()
                        lowered[raw] = low, utf8
                    if damage:
                        h = zlib.crc32(utf8, prefix)
                        if h % damage == 0:
                            at = h % len(low)
                            low = low[:at] + low[at + 1:]
                    counts[low] = counts.get(low, 0) + n
                if len(counts) > COUNTED:
                    yield full()
        if counts:
            yield full()

    docs = docs.select(F.col("doc_id").cast("string").alias("id"),
                       F.col("text").cast("string").alias("text"))
    return (docs.mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


# --- FM-index -----------------------------------------------------------------------------------

class Index:
    """Suffix ranks of ``\\0w\\0w...\\0`` for distinct words (bytes without zero), searched leftwards."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        self.size = n = len(text)
        self.letters, code = np.unique(text, return_inverse=True)
        self.code = np.full(256, -2, np.int64)
        self.code[self.letters] = np.arange(len(self.letters))
        bits = max(1, int(len(self.letters) - 1).bit_length())
        width = 62 // bits
        rank = np.zeros(n, np.int64)
        for k in range(width):  # the first letters of every rotation in one number
            rank = (rank << bits) | np.roll(code, -k)
        while True:  # rotations by twice as many letters each time
            kinds, rank = np.unique(rank, return_inverse=True)
            if len(kinds) == n:
                break
            rank = rank * n + np.roll(rank, -width)
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.before = code[order - 1]  # letter before each suffix, in order of rank
        self.places = np.sort(self.before * n + np.arange(n))
        # Number of the word that begins at a delimiter, by rank.
        self.word = (np.cumsum(text == 0) - 1)[order]

    def extend(self, low, high, code):
        """Intervals of the matches with one letter more on the left; empty where there is none."""
        at = code * self.size
        out = np.searchsorted(self.places, np.concatenate([at + low, at + high]))
        return out[:len(low)], out[len(low):]

    def letters_before(self, low, high):
        """(interval, letter) of the distinct letters, delimiters aside, before each interval."""
        wide = high - low > len(self.letters)
        narrow = np.flatnonzero(~wide)
        sizes = (high - low)[narrow]
        which = np.repeat(narrow, sizes)
        row = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        few = np.unique(which * 256 + self.before[row])
        wide = np.flatnonzero(wide)
        many = (np.repeat(wide * 256, len(self.letters))
                + np.tile(np.arange(len(self.letters)), len(wide)))
        both = np.concatenate([few, many])
        both = both[both % 256 != 0]
        return both // 256, both % 256


def one_edit(index: Index, words: list[bytes], exact: np.ndarray):
    """(query, indexed word) pairs one edit apart, the last ``exact`` letters of the query shared.

    Letters are matched from the end of the word; the error lies before the exact part.
    """
    n = len(words)
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max(initial=0))
    # Column k: k-th letter from the end; -1 beyond the word, -2 where the index lacks it.
    letters = np.full((n, width + 1), -1, np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(n), length)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    letters[row, length[row] - 1 - at] = index.code[flat]
    query = np.arange(n)
    low, high = np.zeros(n, np.int64), np.full(n, int((index.before == 0).sum()), np.int64)
    starts, found = [], []

    def exactly(query, low, high, done):
        """Go on without error from the ``done``-th letter; keep what reaches the delimiter."""
        while len(query):
            over = done == length[query]
            if over.any():
                lo, hi = index.extend(low[over], high[over], np.zeros(int(over.sum()), np.int64))
                hit = hi > lo
                found.append((query[over][hit], index.word[lo[hit]]))
            code = letters[query, done]
            on = ~over & (code >= 0)
            query, low, high, done, code = (x[on] for x in (query, low, high, done, code))
            low, high = index.extend(low, high, code)
            on = high > low
            query, low, high, done = query[on], low[on], high[on], done[on] + 1

    for step in range(width + 1):
        # Letters matched so far: ``step``; from here on the error may come.
        open_ = step >= exact[query]
        if open_.any():
            q, lo, hi = query[open_], low[open_], high[open_]
            which, code = index.letters_before(lo, hi)
            coming = letters[q, step]  # -1 at the word's beginning
            other = code != coming[which]
            which, code = which[other], code[other]
            a, b = index.extend(lo[which], hi[which], code)
            live = b > a
            which, a, b = which[live], a[live], b[live]
            there = np.full(len(which), step)
            inner = step < length[q[which]]
            exactly(q[which], a, b, there)  # one letter more
            exactly(q[which][inner], a[inner], b[inner], there[inner] + 1)  # another letter
            # One letter less: of a run of equal letters the one further left.
            gone = (step < length[q]) & (letters[q, min(step + 1, width)] != coming)
            exactly(q[gone], lo[gone], hi[gone], np.full(int(gone.sum()), step + 1))
        code = letters[query, step]
        on = code >= 0
        query, low, high = query[on], low[on], high[on]
        low, high = index.extend(low, high, code[on])
        on = high > low
        query, low, high = query[on], low[on], high[on]
        if not len(query):
            break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = max(1, int((index.before == 0).sum()))
    pairs = np.unique(np.concatenate([q * total + w for q, w in found]))
    return pairs // total, pairs % total


# --- near words ---------------------------------------------------------------------------------

def _halves(words: DataFrame) -> DataFrame:
    """(side, half, asks, word, n): the halves a word may share; ``asks`` where it is its own half."""
    size = F.length("word")
    rows = []
    for side in ("p", "s"):
        up = 0 if side == "p" else 1
        own = F.floor((size + up) / 2)
        for k in sorted({-1, 0, 1}):
            part = F.floor((size + k + up) / 2)
            rows.append(F.struct(F.lit(side).alias("side"), part.cast("int").alias("k"),
                                 (part == own).alias("asks")))
    return (words.withColumn("part", F.explode(F.array_distinct(F.array(*rows))))
            .select("part.side", "part.asks", "word", "n",
                    F.when(F.col("part.side") == "p", F.substring("word", F.lit(1), F.col("part.k")))
                    .otherwise(F.expr("substring(word, length(word) - part.k + 1)")).alias("half")))


def _best(side: str, index: Index, words: list[bytes], counts: np.ndarray, asking: list[bytes]):
    """(word, number of near words, the most frequent one, its count) of the words that ask.

    ``words``, those of the index, are in order of code points.
    """
    asking = sorted(asking, key=len)
    at = 0
    while at < len(asking):
        to = at + 1
        while to < len(asking) and (to + 1 - at) * len(asking[to]) <= CELLS:
            to += 1
        part = asking[at:to]
        at = to
        exact = np.array([(len(w) + (side == "s")) // 2 for w in part], np.int64)
        asker, found = one_edit(index, part if side == "s" else [w[::-1] for w in part], exact)
        if side == "s" and len(asker):  # those that share the prefix too were found there
            new = np.array([not words[j].startswith(part[i][:len(part[i]) // 2])
                            for i, j in zip(asker.tolist(), found.tolist())])
            asker, found = asker[new], found[new]
        order = np.lexsort((found, -counts[found], asker))
        asker, found = asker[order], found[order]
        new = np.ones(len(asker), bool)
        new[1:] = asker[1:] != asker[:-1]
        first = np.flatnonzero(new)
        yield ([part[i] for i in asker[first].tolist()], np.diff(np.append(first, len(asker))),
               [words[j] for j in found[first].tolist()], counts[found[first]])


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of every word that has a near word in ``words(word, n)``."""
    keyed = written(_halves(words), "halves")
    # A half that very many words share: the indexed words are dealt in blocks, and all ask in each.
    wide = (keyed.groupBy("side", "half").agg(F.count("*").alias("size"))
            .filter(F.col("size") > BLOCK)
            .select("side", "half", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    keyed = keyed.join(wide, ["side", "half"], "left").withColumn("blocks",
                                                                  F.coalesce("blocks", F.lit(1)))
    own = (F.crc32(F.encode("word", "ISO-8859-1")) % F.col("blocks")).cast("int")
    dealt = keyed.withColumn("block", F.explode(
        F.when(F.col("asks") & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1))
        .otherwise(F.array(own)))).withColumn("held", F.col("block") == own)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()),
                        ("best_n", pa.int64())])

    def run(batches):
        now = side_now = index = words = counts = None
        split, held, asking = False, {}, []

        def search():
            nonlocal index, words, counts
            if held and asking:
                if index is None:
                    words = sorted(held)
                    counts = np.array([held[w] for w in words], np.int64)
                    index = Index(words if side_now == "s" else [w[::-1] for w in words])
                for a, n, b, m in _best(side_now, index, words, counts, asking):
                    text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [text(a), pa.array(n, pa.int64()), text(b), pa.array(m, pa.int64())],
                        schema=schema)
            asking.clear()

        for batch in batches:
            for side, half, block, of, word, n, asks, holds in zip(
                    *(batch.column(c).to_pylist() for c in
                      ("side", "half", "block", "blocks", "word", "n", "asks", "held"))):
                if (side, half, block) != now:
                    # Whole groups share an index; a block of a wide half has its own.
                    if side != side_now or split or of > 1 or len(held) >= BLOCK:
                        yield from search()
                        held.clear()
                        index = None
                    now, side_now, split = (side, half, block), side, of > 1
                word = word.encode("latin-1")
                if holds:
                    held[word] = n
                elif len(asking) >= BLOCK:  # words held come first, so the index is whole
                    yield from search()
                if asks:
                    asking.append(word)
        yield from search()

    found = (dealt.repartition("side", "half", "block")
             .sortWithinPartitions("side", "half", "block", F.desc("held"))
             .select("side", "half", "block", "blocks", "word", "n", "asks", "held")
             .mapInArrow(run, "word string, n_near long, best string, best_n long"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last word reached; each round doubles the way."""
    way = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if way.join(on, "root").isEmpty():
            return way
        way = written(way.join(on, "root", "left")
                      .select("word", F.coalesce("beyond", "root").alias("root")), "forms")


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words(word, n)`` that is long and
    frequent enough.

    Near words are one inserted, deleted or replaced code point apart. A word's form is its most
    frequent near word (ties: smallest in code-point order), if ``factor`` times as frequent or
    more; root is reached by following forms, the word itself if it has none. Words must be of
    Latin-1 letters, of two code points or more, and distinct. An empty table gives no rows.
    """
    words = written(words.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))
                    .select("word", F.col("n").cast("long").alias("n")), "words")
    close = near(words)
    out = words.join(close, "word", "left")
    good = F.col("best_n") >= factor * F.col("n")
    out = written(out.select("word", F.when(good, F.col("best")).alias("form"), "n",
                             F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(good, F.col("best_n")).alias("form_n")), "near")
    way = roots(out.filter("form is not null"))
    return (out.join(way, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                    "form_n"))
