"""Corpus pipeline: toxic texts go, one of near-equal texts stays, texts that hold benchmark items
go, personal data is blotted out and what is left is encoded.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes as
Parquet and reads again as the ``docs`` of the next. All stages but the last return the columns
of ``documents``. Nulls, empty texts and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateauscope.llm import bpe, decontam, ngram_join, pii
from plateauscope.llm.tables import table, written
from plateauscope.llm.toxicity import Toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are scored toxic."""
    return Toxicity(docs, table(spark, sf_dir, "labels")).accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal ones: that of smallest doc_id."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents into which a benchmark item leaks."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind."""
    return pii.scrub(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the text they decode to.

    Columns of ``docs`` of the same names give way to these.
    """
    out = bpe.encode(docs, keep=[c for c in docs.columns if c not in ("ids", "decoded", "n_tokens")])
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe_encoding", encoding),
]

# Nearest neighbours, redaction and encoding are beyond SQL; tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
