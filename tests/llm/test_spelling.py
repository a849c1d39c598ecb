"""Spelling variants: all pairs compared, both directions of the index, hot halves, awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from __spark_entry__ import queries
from conftest import SF
from plateauscope.llm import spelling as S
from test_corpus import table


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(count, least=5, often=3):
    words = {w: n for w, n in count.items() if len(w) >= least and n >= often}
    keys = {}  # words that share a half of the shorter one, to spare most comparisons
    for w in words:
        for k in {(len(w) - 1) // 2, len(w) // 2}:
            keys.setdefault((0, w[:k]), set()).add(w)
            keys.setdefault((1, w[len(w) - k:]), set()).add(w)
    near = {w: set() for w in words}
    for group in keys.values():
        for a in group:
            near[a] |= {b for b in group if abs(len(a) - len(b)) < 2 and one_apart(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def counted(rows, damage=None):
    out = Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return out


def got(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcd", "aé÷ÿ"])
def test_index_finds_all_and_only_words_one_edit_apart(alphabet):
    rng = random.Random(alphabet)
    one = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    for _ in range(60):
        words = sorted({one(alphabet) for _ in range(40)})
        asked = sorted({one(alphabet + "z") for _ in range(20)} | set(words[:10]))
        for side, turn in (("s", 1), ("p", -1)):
            exact = np.array([(len(w) + (side == "s")) // 2 for w in asked])
            coded = lambda ws: [w[::turn].encode("latin-1") for w in ws]
            a, b = S.one_edit(S.Index(coded(words)), coded(asked), exact)
            found = list(zip(a.tolist(), b.tolist()))
            assert len(found) == len(set(found))
            assert set(found) == {
                (i, j) for i, x in enumerate(asked) for j, y in enumerate(words)
                if one_apart(x, y) and x != y
                and x[::turn][-exact[i]:] == y[::turn][-exact[i]:]}


@pytest.mark.parametrize("block", [40_000, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "CELLS", 4_000_000 if block > 7 else 20)
    rng = random.Random(2)
    words = {}
    for _ in range(500):  # half of them share a half
        w = rng.choice(["abab", "", "é"]) + "".join(rng.choice("abé÷") for _ in range(rng.randint(2, 6)))
        words[w + rng.choice(["", "abab"])] = rng.choice([1, 2, 3, 4, 8, 8, 20, 50, 300])
    words["a" * 3000] = words["a" * 2999] = 5
    words["a" * 2998] = 20
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.variants(frame.repartition(3))) == expected(words)


def test_counts_fold_and_damage(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 40)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(50)]), " ".join(
        rng.choice(["Café", "café", "CAFÉ", "naïves", "STRAẞE", "straße", "x1y", "don't", "×÷ab", "日本a"])
        + rng.choice("abc") * rng.randint(0, 3) for _ in range(rng.randint(0, 40)))) for _ in range(200)]
    rows += [(1, None), (2, ""), (3, "é" * 70_000), (4, " ".join(["longer words"] * 9000))]
    for damage in (None, 7):
        frame = S.count_words(table(spark, rows, extra=True), damage=damage)
        assert {r.word: r.n for r in frame.collect()} == {
            w: n for w, n in counted(rows, damage).items() if w or n} | (
                {"": n} if (n := counted(rows, damage)[""]) else {})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert S.variants(none).count() == 0
    assert S.count_words(table(spark, [])).count() == 0
    some = spark.createDataFrame([("alone", 9), ("rare", 1)], "word string, n long")
    assert got(S.variants(some)) == {("alone", None, "alone", 9, 0, None)}


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = queries()["op12_spelling_variants"](spark, SF)
    assert got(frame) == expected(counted(rows, 97))
