"""Secrets: fixed patterns, and strings that a tokenizer cannot shorten.

Base kinds (assign, access, hex) follow their patterns. The added kind ``random`` looks at unbroken
runs of letters, digits and the signs of base64. A public byte-level vocabulary spends a token on
several characters of anything people write or name, but on fewer than two and a half of a random
string. Before that test, digests of known lengths, UUIDs, numbers, times, file names and embedded
data are set aside; after it, runs that read as words joined by signs or capitals.
"""

from __future__ import annotations

import base64
import re
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
LEAST = 20  # characters of a run that may be random, 16 at least
RATIO = 2.25  # characters a token, at most
PIECE = 1000  # characters handed to the tokenizer at once

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGESTS = (32, 40, 48, 56, 64, 96, 128)  # hexadecimal digits of MD5, SHA-1, Tiger, SHA-2
_ALL_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})\Z")
_NUMBER = re.compile(r"[0-9+/_-]+T?[0-9-]*Z?\Z")
_DIGEST_NAME = re.compile(r"(?:sha-?[0-9]{0,3}|md5|crc32|checksum|digest|integrity|commit|etag)"
                          r"[\"']?[\x20:=-]{1,3}[\"']?\Z", re.I | re.A)
_DATA = re.compile(r";base64,\Z")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _named(run: str) -> bool:
    """Whether a run reads as an identifier: mostly parts of four letters or more."""
    parts = _PART.findall(run)
    return 2 * sum(len(p) for p in parts if len(p) > 3 and not p.isdigit()) >= len(run)


def known(run: str, before: str) -> bool:
    """Digests, identifiers and embedded data, which are no secrets."""
    bare = run.rstrip("=")
    return bool(len(bare) in _DIGESTS and _ALL_HEX.match(bare) or _UUID.match(bare)
                or _NUMBER.match(bare) or _DIGEST_NAME.search(before) or _DATA.search(before)
                or _named(bare))


def encoder_of(source: bytes, pattern: str):
    """The tokenizer of this process, built once for a vocabulary."""
    import tiktoken
    home = sys.modules.setdefault("_plateauscope_encoders", types.ModuleType("_plateauscope_encoders"))
    kept = home.__dict__.setdefault("kept", {})
    if hash(source) not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
        kept.clear()
        kept[hash(source)] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                               special_tokens={})
    return kept[hash(source)]


def ratio(run: str, encoder) -> float:
    """Characters a token."""
    return len(run) / sum(len(encoder.encode_ordinary(run[i:i + PIECE]))
                          for i in range(0, len(run), PIECE))


def _base(text: str):
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def spans_of(text: str | None, encoder, least: int = LEAST, most: float = RATIO) -> list[tuple]:
    """(kind, start, end, characters a token or null), by start, then kind as listed.

    Code points, end exclusive. A random run that meets a base span is that span and not listed.
    """
    text = text or ""
    found = [(*s, None) for s in _base(text)]
    taken = sorted(s[1:3] for s in found)
    at = 0
    for m in _RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        if len(run) < least:
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end or known(run, text[max(0, start - 24):start]):
            continue
        if not any(c.isdigit() for c in run) and (run.islower() or run.isupper()):
            continue  # one case and no digit: letters of a word or a long name
        r = ratio(run, encoder)
        if r <= most:
            found.append(("random", start, end, r))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str, spans: list[tuple]) -> str:
    """``text`` with every span (overlapping ones as one) replaced by the kind in brackets."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                   ("ratio", pa.float64())])


def find(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None,
         least: int = LEAST, most: float = RATIO) -> DataFrame:
    """(doc_id, spans, redacted) of every row of ``docs(doc_id, text)``.

    A null text is an empty one (no spans, redacted null). Rows that repeat a doc_id, or have none,
    are rows of their own; other columns are ignored; an empty table gives no rows. The whole text is
    read whatever its length. ``vocabulary`` is a file of ranks, read on the driver and handed to the
    executors (about 1 MB); ``pattern`` parts a text before ranks apply.
    """
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    with open(vocabulary or default_vocabulary(), "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_ITEM)),
                        ("redacted", pa.string())])

    def run(batches):
        encoder = encoder_of(source.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("text").to_pylist()
                found = [spans_of(t, encoder, least, most) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.array([[dict(zip(("kind", "start", "end", "ratio"), s)) for s in f]
                              for f in found], pa.list_(_ITEM)),
                    pa.array([redacted(t, f) if f else t for t, f in zip(texts, found)],
                             pa.string())], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,"
                                "ratio:double>>, redacted string")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts by kind, digest of the base spans and the list of all spans, per row."""
    found = find(docs, vocabulary)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
                        F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
