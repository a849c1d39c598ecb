"""Labelled rows from which the classifiers of this subpackage learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows that are not held out.

    The rows are those of smallest hash of doc_id, so they depend on the ids alone. Labels that
    are null, or repeat a doc_id with another value, are left out, and of texts that repeat
    a doc_id the smallest counts; a null text is an empty one.
    """
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
             .filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("hi"))
             .filter("y = hi").select("doc_id", "y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` pairs of numbers.
    return (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(few), "doc_id")
            .groupBy("doc_id", "y").agg(F.min("text").alias("text"))
            .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y"))
