"""Byte-pair encoding and decoding with a public vocabulary.

A word is encoded without replaying merges. An Aho-Corasick automaton finds every token that
occurs in the word; the encoder walks from the left, takes the longest token that starts where
it stands and is compatible with the one before, and steps back when none is. Two neighbours
are compatible when merging in order of rank would keep the seam between them, which the table
of merges decides by undoing the later merge on either side of the seam (results are kept in a
pair table). The encoding of a prefix is unique, so a position left once is never entered
again and the walk is linear in the word.

Decoding copies token texts out of one byte string by a table of offsets.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 250_000  # words whose encoding a worker keeps
PAIRS_KEPT = 1_000_000
# White_Space of Unicode, as the vocabulary's word pattern means it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def _byte_names() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one vocabulary file (word-level BPE with an end-of-word suffix)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first_merged = len(vocab) - len(merges)
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = [0] * len(vocab), [0] * len(vocab)
        for rank, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if t != self.first_merged + rank:
                raise ValueError("token ids must follow the ranks of the merges")
            self.left[t], self.right[t] = vocab[a], vocab[b]
            self.pair[vocab[a], vocab[b]] = t
        # A token as symbols: one character a byte, the last one raised by 256 at a word's end.
        names = _byte_names()
        self.matcher = ahocorasick.Automaton()
        for text, t in vocab.items():
            ends = text.endswith(self.suffix) and text != self.suffix
            body = [names[c] for c in (text[:-len(self.suffix)] if ends else text)]
            if ends:
                body[-1] += 256
            self.matcher.add_word("".join(map(chr, body)), (len(body), t))
        self.matcher.make_automaton()
        self.added_pattern = regex.compile(
            "|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)))
        # Token texts, each with the space that parts it from the next, and where each begins.
        texts = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for text, t in [*vocab.items(), *self.added.items()]:
            texts[t] = text
        parts = [f"{t} ".encode() for t in texts]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.words: dict[str, bytes] = {}
        self.seams: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand next to each other in an encoding."""
        known = self.seams.get((a, b))
        if known is None:
            if len(self.seams) >= PAIRS_KEPT:
                self.seams.clear()
            known = self.seams[a, b] = self._keeps_seam(a, b)
        return known

    def _keeps_seam(self, a: int, b: int) -> bool:
        base = self.first_merged
        taken_a = taken_b = len(self.left) + 1  # merge that took the token at the seam
        while True:
            t = self.pair.get((a, b))
            # At equal rank the merge further left comes first.
            if t is not None and t < taken_a and t <= taken_b:
                return False
            if a >= base and a > b:
                taken_a, a = a, self.right[a]
            elif b >= base:
                taken_b, b = b, self.left[b]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
        here: list[list[tuple[int, int]]] = [[] for _ in symbols]
        for end, (size, t) in self.matcher.iter(symbols):
            here[end - size + 1].append((size, t))
        for found in here:
            found.sort(reverse=True)
        stack: list[tuple[int, int, int]] = []  # size, token, its place among those that start there
        closed = [False] * (len(symbols) + 1)
        at = place = 0
        while at < len(symbols):
            found = here[at]
            while place < len(found):
                size, t = found[place]
                if not closed[at + size] and (not stack or self.compatible(stack[-1][1], t)):
                    stack.append((size, t, place))
                    at, place = at + size, 0
                    break
                place += 1
            else:
                closed[at] = True
                size, _, place = stack.pop()
                at -= size
        return [t for _, t, _ in stack]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form
        words, known = _WORD.findall(text.lower()), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    ids = known[w] = np.array(self.encode_word(w), "<u4").tobytes()
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        if "<" not in text:
            return self._plain(text)
        out, done = [], 0
        for m in self.added_pattern.finditer(text):
            out += [self._plain(text[done:m.start()]),
                    self.added[m[0]].to_bytes(4, "little")]
            done = m.end()
        return b"".join([*out, self._plain(text[done:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids: token texts parted by one space."""
        t = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(t):
            return b""
        start = self.offsets[t]
        size = self.offsets[t + 1] - start
        to = np.cumsum(size)
        at = np.arange(int(to[-1])) + np.repeat(start - (to - size), size)
        return self.blob[at[:-1]].tobytes()


def codec_of(source: str) -> Codec:
    """The codec of this process: built once, and its word table outlives a task."""
    home = sys.modules.setdefault("_plateauscope_codecs", types.ModuleType("_plateauscope_codecs"))
    kept = home.__dict__.setdefault("kept", {})
    if hash(source) not in kept:
        kept.clear()
        kept[hash(source)] = Codec(source)
    return kept[hash(source)]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id), then ids (binary, little-endian unsigned 32-bit) and decoded.

    A null or empty text has no ids and decodes to an empty text. Rows that repeat a doc_id, or
    have none, are rows of their own; other columns than ``text`` and ``keep`` are ignored.
    The vocabulary file is read on the driver and handed to the executors (a few MB).
    """
    keep = keep or ["doc_id"]
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = docs.select(*keep).schema.add("ids", "binary").add("decoded", "string")

    def run(batches):
        codec = codec_of(source.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = [codec.encode(t) for t in part.column("_text").to_pylist()]
                texts = pa.array([codec.decode(i) for i in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(ids, pa.binary()), texts],
                    names=[*keep, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode(docs, vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
