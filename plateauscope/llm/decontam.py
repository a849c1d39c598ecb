"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

A benchmark item is a set of five-word shingles, and so is a document. An item leaks into a
document when the document holds ``num / den`` of the item's shingles or more. Items are
partitioned by size; each partition keeps a bottom-k MinHash sketch of its items (their k
shingles of smallest hash), with k set by the partition's largest size ``q`` as
``q - ceil(num * q / den) + 1``. So many shingles of an item cannot all be missing from a
document that meets the threshold: the search for sketch values in whole documents of any
length proposes every leak. The proposed documents are then held against all shingles of the
items, compared as text.

Only DataFrame functions are used. Sketches and item shingles are handed out in blocks of at
most ``BLOCK_ROWS`` rows, so each broadcast has a fixed bound whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plateauscope.llm.tables import written

NUM, DEN, WIDTH = 75, 100, 5
BLOCK_ROWS = 200_000  # of about 100 bytes: 20 MB in each executor


def _words():
    return F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")


def _shingled(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep..., words, i, h): a row for every ``width``-word window of ``text``."""
    at = df.select(*keep, _words().alias("words")).filter(F.size("words") >= width)
    at = at.select(*keep, "words", F.explode(
        F.sequence(F.lit(0), F.size("words") - width)).alias("i"))
    return at.withColumn("h", F.xxhash64(*(F.get("words", F.col("i") + k) for k in range(width))))


def _as_text(width: int):
    return F.concat_ws(" ", *(F.get("words", F.col("i") + k) for k in range(width)))


def _items(bench: DataFrame) -> DataFrame:
    """(item_id, item_key, text) of the items, each once."""
    return (bench.select(F.col("item_id"), F.xxhash64("text").alias("item_key"), "text")
            .filter("item_id IS NOT NULL AND text IS NOT NULL").distinct())


def item_shingles(bench: DataFrame, num: int = NUM, den: int = DEN,
                  width: int = WIDTH) -> DataFrame:
    """(item_id, item_key, h, shingle, q, sketched) of the distinct shingles of every item."""
    s = (_shingled(_items(bench), width, "item_id", "item_key")
         .select("item_id", "item_key", "h", _as_text(width).alias("shingle")).distinct())
    # An item is one short text, and a window holds the shingles of one.
    of_item = Window.partitionBy("item_id", "item_key")
    s = s.withColumn("q", F.count("*").over(of_item))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("q")) + 1) - 1  # of the item's size partition
    k = largest - F.ceil(largest * num / den) + 1
    return s.withColumn("sketched", F.row_number().over(of_item.orderBy("h", "shingle")) <= k)


def _blocks(df: DataFrame, block_rows: int) -> Iterator[DataFrame]:
    """``df`` in blocks of at most about ``block_rows`` rows, dealt by item."""
    n = max(1, -(-df.count() // block_rows))
    for i in range(n):
        yield df if n == 1 else df.filter(F.pmod(F.xxhash64("item_id", "item_key"), F.lit(n)) == i)


def _short(keyed: DataFrame, bench: DataFrame, width: int, block_rows: int) -> list[DataFrame]:
    """Leaks of items of fewer than ``width`` words: a frame for each number of words that occurs."""
    at = _items(bench).withColumn("w", F.size(_words()))
    at = written(at.filter((F.col("w") > 0) & (F.col("w") < width)), "short_items")
    out = []
    for w in sorted(r["w"] for r in at.select("w").distinct().collect()):  # fewer than ``width``
        items = _shingled(at.filter(F.col("w") == w), w, "item_id", "item_key").select(
            "item_id", "item_key", "h", _as_text(w).alias("shingle"))
        rows = _shingled(keyed, w, "doc_id", "text_key")
        out += [rows.join(F.broadcast(b), "h").filter(F.col("shingle") == _as_text(w))
                .select("doc_id", "text_key", "item_id", "item_key", F.lit(1).cast("long").alias("q"), "h")
                .distinct() for b in _blocks(items, block_rows)]
    return out


def leaks(docs: DataFrame, bench: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_shared, containment) of every leak.

    ``docs(doc_id, text)`` and ``bench(item_id, text)``; other columns are ignored. Words are
    runs of letters and digits, lower-cased. An item of fewer than ``width`` words is one shingle:
    it leaks where its words stand in a row. Texts that are null or without words are not searched. Rows
    that repeat a doc_id are searched one by one and told apart by ``text_key``; identical
    rows give one. A row without doc_id is searched too and keeps its null. Items without
    item_id are left out; of texts that repeat an item_id the best one counts.
    """
    items = written(item_shingles(bench, num, den, width), "items")
    docs = docs.select(F.col("doc_id"), F.col("text")).filter("text IS NOT NULL")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    rows = _shingled(keyed, width, "doc_id", "text_key")
    found = [rows.join(F.broadcast(b.select("h", "item_id", "item_key")), "h")
             .select("doc_id", "text_key", "item_id", "item_key")
             for b in _blocks(items.filter("sketched"), block_rows)]
    proposed = written(reduce(DataFrame.unionByName, found).distinct(), "proposed")

    again = F.xxhash64("text").alias("text_key")
    near = (keyed.alias("d").join(
        proposed.select("doc_id", "text_key").distinct().alias("p"),
        F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("d.text_key") == F.col("p.text_key")), "left_semi"))
    near = _shingled(near.select("doc_id", "text", again), width, "doc_id", "text_key")
    # Equal hash and equal text; written so that only rows of equal hash build the text.
    same = (F.contains(F.col("shingle"), _as_text(width))
            & F.contains(_as_text(width), F.col("shingle")))
    held = [near.join(F.broadcast(b.drop("sketched")), "h").filter(same)
            .select("doc_id", "text_key", "item_id", "item_key", "q", "h").distinct()
            for b in _blocks(items, block_rows)]
    held += _short(keyed, bench, width, block_rows)
    counted = (reduce(DataFrame.unionByName, held).groupBy("doc_id", "text_key", "item_id",
                                                           "item_key")
               .agg(F.first("q").alias("q"), F.count("*").alias("shared"))
               .filter(F.col("shared") * den >= F.col("q") * num))
    best = F.max_by(F.struct("q", "shared"), F.struct(F.col("shared") / F.col("q"), "q"))
    return (counted.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b"))
            .select("doc_id", "text_key", "item_id", F.col("b.q").alias("n_shingles"),
                    F.col("b.shared").alias("n_shared"),
                    (F.col("b.shared") / F.col("b.q")).alias("containment")))


def clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows into which some item of ``bench`` leaks; all columns stay."""
    bad = leaks(docs, bench, **options).select("doc_id", "text_key").distinct().alias("b")
    d = docs.alias("d")
    return d.join(bad, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
                  & (F.xxhash64("d.text") == F.col("b.text_key")), "left_anti")
