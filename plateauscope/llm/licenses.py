"""License scan: base phrases by place, license notices by an exact set-similarity join.

A notice is a set of words. A block carries the notice when it holds ``num / den`` of those words or
more. Blocks are the lines of a text and, so that a notice may wrap, all runs of as many words as
the notice has, across lines. The join of lines is exact and uses the usual filters: words are
ordered by their frequency over the whole corpus, rarest first; a block that lacks all of the
first ``|T| - o + 1`` words of a notice (``o`` = words needed) cannot carry it (prefix); nor
can one with fewer than ``o`` words (length), or with too few words left in the order after the
first common one (position). A run that carries a notice has one of those first words too, so only
the runs around such a word are compared.

Only DataFrame functions are used. The notices are a parameter of at most ``MAX_WORDS`` words
in all, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateauscope.llm.tables import written

NUM, DEN = 80, 100
MAX_WORDS = 20_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache",
           "cc by": "cc-by", "mit license": "mit"}

# Usual wordings of notices and the label each one gives.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mit", "released under the mit license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification "
            "are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("all-rights-reserved", "copyright all rights reserved"),
)


def normal(text: Column) -> Column:
    """Words parted by one space: ASCII letters (lower-cased), digits and all beyond ASCII."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, text_key, n_words, n_base, first_word, last_word, found) of every row."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), normal(F.col("text")).alias("t"))
    d = d.withColumn("n_words", F.when(F.col("t") == "", 0).otherwise(_spaces(F.col("t")) + 1))
    d = d.withColumn("t", F.concat(F.lit(" "), "t", F.lit(" ")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        mark = f" {phrase} "
        has = F.contains(F.col("t"), F.lit(mark))
        # Two places in a row share the space between them, so it stays with the next one.
        counts.append(F.when(has, F.size(F.split("t", f" {phrase}(?= )")) - 1).otherwise(0))
        before = _spaces(F.substring_index("t", mark, 1))
        after = _spaces(F.substring_index("t", mark, -1))
        firsts.append(F.when(has, before))
        lasts.append(F.when(has, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    least = lambda cs: F.array_min(F.array(*cs))
    most = lambda cs: F.array_max(F.array(*cs))
    return d.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"),
                    sum(counts[1:], counts[0]).cast("long").alias("n_base"),
                    least(firsts).cast("long").alias("first_word"),
                    most(lasts).cast("long").alias("last_word"),
                    F.array_distinct(F.array_compact(F.array(*labels))).alias("found"))


def notice_words(spark: SparkSession, notices=NOTICES) -> DataFrame:
    rows = [(i, label, w, len(text.split())) for i, (label, text) in enumerate(notices)
            for w in sorted(set(text.split()))]
    if len(rows) > MAX_WORDS:
        raise ValueError(f"the notices have {len(rows)} words; at most {MAX_WORDS}")
    return spark.createDataFrame(rows, "notice int, label string, word string, run int")


def notice_matches(docs: DataFrame, notices=NOTICES, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text_key, block, label, containment) of every block that carries a notice.

    ``block`` is the number of the line; null for the best run of words around a rare word.
    """
    spark = docs.sparkSession
    words = notice_words(spark, notices)
    vocabulary = F.broadcast(words.select("word").distinct())
    texts = docs.select(F.explode(F.split(normal(F.col("text")), " ")).alias("word"))
    frequency = texts.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("f"))
    of_notice = Window.partitionBy("notice")
    ranked = (words.join(frequency, "word", "left").fillna(0, ["f"])
              .withColumn("size", F.count("*").over(of_notice))
              .withColumn("place", F.row_number().over(of_notice.orderBy("f", "word")) - 1)
              .withColumn("needed", F.ceil(F.col("size") * num / F.lit(den)))
              .withColumn("prefix", F.col("place") <= F.col("size") - F.col("needed")))
    ranked = written(ranked, "notices")
    # At most MAX_WORDS words: the prefixes become one literal of the plan.
    rare = [r[0] for r in ranked.filter("prefix").select("word").distinct().collect()]
    least = ranked.agg(F.min("needed")).first()[0]

    blocks = (docs.filter("text IS NOT NULL")
              .select("doc_id", F.xxhash64("text").alias("text_key"),
                      F.posexplode(F.split("text", "\n")).alias("block", "line")))
    blocks = blocks.select("doc_id", "text_key", "block",
                           F.split(normal(F.col("line")), " ").alias("w"))
    blocks = (blocks.filter(F.size("w") >= least)
              .filter(F.arrays_overlap("w", F.array(*map(F.lit, rare))))
              .withColumn("w", F.array_distinct("w")).withColumn("n", F.size("w")))
    hits = (blocks.select("doc_id", "text_key", "block", "n", F.explode("w").alias("word"))
            .join(F.broadcast(ranked), "word"))
    per = hits.groupBy("doc_id", "text_key", "block", "notice").agg(
        F.first("label").alias("label"), F.first("size").alias("size"),
        F.first("needed").alias("needed"), F.first("n").alias("n"),
        F.min("place").alias("place"), F.count("*").alias("common"))
    lines = (per.filter("n >= needed AND size - place >= needed AND common >= needed")
             .select("doc_id", "text_key", "block", "label",
                     (F.col("common") / F.col("size")).alias("containment")))
    return lines.unionByName(_run_matches(docs, ranked, rare))


def _run_matches(docs: DataFrame, ranked: DataFrame, rare: list[str]) -> DataFrame:
    """The notices that a run of as many words carries, whatever lines it crosses."""
    longest = ranked.agg(F.max("run")).first()[0] or 1
    sets = ranked.groupBy("notice").agg(
        F.first("label").alias("label"), F.first("run").alias("run"), F.first("size").alias("size"),
        F.first("needed").alias("needed"), F.collect_list("word").alias("words"))
    sets = F.broadcast(ranked.filter("prefix").select("notice", "word").join(sets, "notice"))
    texts = (docs.filter("text IS NOT NULL")
             .select("doc_id", F.xxhash64("text").alias("text_key"),
                     F.split(normal(F.col("text")), " ").alias("w"))
             .filter(F.arrays_overlap("w", F.array(*map(F.lit, rare)))))
    # Every rare word with the words around it, at most ``longest - 1`` on either side.
    around = F.filter(F.transform("w", lambda x, i: F.when(x.isin(rare), F.struct(
        x.alias("word"), F.least(i + 1, F.lit(longest)).alias("at"),
        F.slice("w", F.greatest(i + 2 - longest, F.lit(1)), F.lit(2 * longest - 1)).alias("near")))),
        lambda x: x.isNotNull())
    found = (texts.select("doc_id", "text_key", F.explode(around).alias("x"))
             .select("doc_id", "text_key", "x.*").join(sets, "word")
             .filter(F.size(F.array_intersect("near", "words")) >= F.col("needed")))
    runs = F.transform(F.sequence(F.greatest(F.col("at") - F.col("run") + 1, F.lit(1)), "at"),
                       lambda i: F.size(F.array_intersect(F.slice("near", i, F.col("run")),
                                                          F.col("words"))))
    return (found.withColumn("common", F.array_max(runs)).filter("common >= needed")
            .select("doc_id", "text_key", F.lit(None).cast("int").alias("block"), "label",
                    (F.col("common") / F.col("size")).alias("containment")))


def scan(docs: DataFrame, notices=NOTICES, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row per row of ``docs(doc_id, text)``: places of the phrases, labels and score.

    ``score`` is the largest containment of a notice found in a block, 1 where a phrase stands,
    else 0. A null text is an empty one: no words, no labels. Rows that repeat a doc_id are
    scanned one by one; a row without doc_id keeps its null. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = (notice_matches(docs, notices, num, den).groupBy("doc_id", "text_key")
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))
    d, f = phrase_places(docs).alias("d"), found.alias("f")
    both = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                  & (F.col("d.text_key") == F.col("f.text_key")), "left")
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    none = F.array().cast("array<string>")
    return both.select(
        "d.doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("found")).alias("base_labels"),
        joined(F.array_union("found", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
