"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are kept whenever their pattern and check hold. Added kinds
(iban, ssn) are kept when the score, raised or lowered by the words around, reaches
``THRESHOLD``. All patterns run in time linear in the text: a pattern that begins with a
repeated class is entered once per run of that class, never once per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED
THRESHOLD = 0.5
REACH = 40  # code points of context on either side

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

# Length of an IBAN by country (ISO 13616 registry); of others every length is tried.
_IBAN_LENGTH = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
    "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
    "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}

# Score of a confirmed span without context, and the words that raise or lower it.
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
_NEAR = {
    "email": r"e-?mail|contact|mailto|correo|courriel",
    "ip": r"ip|host|server|address|client",
    "card": r"card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|tax id",
}
_NEAR = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in _NEAR.items()}
_AGAINST = re.compile(r"(?<!\w)(?:version|isbn|order|serial|sample|test)(?!\w)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits moved behind the rest, letters as 10 to 35."""
    turned = iban[4:] + iban[:4]
    rest = 0
    for c in turned:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the whole run before an @ that a domain follows."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            # The run of local characters that ends at the @, not into the match before.
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the length of the country, else the longest that mod-97 confirms.

    The span ends where no letter or digit follows. After a span that fails, the search goes on
    behind its country code and check digits.
    """
    at = 0
    while m := _IBAN.search(text, at):
        at = m.end()
        rest = _IBAN_REST.match(text, at)
        if not rest:
            continue
        places = [i for i in range(at, rest.end()) if text[i] != " "]
        known = _IBAN_LENGTH.get(text[m.start():m.start() + 2])
        for n in (known,) if known else range(len(places) + 4, 14, -1):
            if n - 4 > len(places):
                continue
            end = places[n - 5] + 1
            if (text[end:end + 1].isascii() and text[end:end + 1].isalnum()
                    or not mod97(text[m.start():end].replace(" ", ""))):
                continue
            yield m.start(), end
            at = end
            break


def _digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, by kind as listed and by start."""
    if "@" in text:
        yield from (("email", *s) for s in _emails(text))
    first = _DIGIT.search(text)
    if not first:
        return
    at = first.start()
    for m in _IP.finditer(text, at):
        if all(map(_small, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text, at):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", *s) for s in _ibans(text))
    for m in _SSN.finditer(text, at):
        yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - REACH):start] + " \x00 " + text[end:end + REACH]
    return (_SCORE[kind] + 0.3 * bool(_NEAR[kind].search(around))
            - 0.3 * bool(_AGAINST.search(around)))


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score from 0 to 1) in code points, end exclusive."""
    out = []
    for kind, start, end in _proposed(text or ""):
        s = score(text, kind, start, end)
        if kind in BASE or s >= threshold:
            out.append((kind, start, end, min(1.0, max(0.0, s))))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with every span (overlapping ones as one) replaced by the kind in brackets."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans, redacted) of every row of ``docs(doc_id, text)``.

    A null text is an empty one (no spans, redacted null). Rows that repeat a doc_id, or have
    none, are rows of their own. Other columns are ignored. The whole text is read whatever
    its length.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(item)),
                        ("redacted", pa.string())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("text").to_pylist()
                found = [spans_of(t) if threshold == THRESHOLD else spans_of(t, threshold)
                         for t in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in f]
                              for f in found], pa.list_(item)),
                    pa.array([redacted(t, f) if f else t for t, f in zip(texts, found)],
                             pa.string())], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, spans {_SPANS}, redacted string")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, per row."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
                        F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])),
                                   F.lit(0.0)).alias("top_score"))


def scrub(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kind; every row and column stays.

    ``n_chars``, where it exists, becomes the length of the new text.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("text").to_pylist()
                found = [spans_of(t, threshold) for t in texts]
                new = [redacted(t, f) if f else t for t, f in zip(texts, found)]
                columns = [pa.array(new, c.type) if n == "text" else c
                           for n, c in zip(names, part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out.select(names)
