"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.llm import (bpe, conversations, decontam, embed_dedup, licenses, main_text,
                              ngram_join, pii, quality, secret_scan, spelling, suffix_dedup,
                              toxicity)
from plateauscope.llm.oracles import ORACLES
from plateauscope.llm.tables import QUERIES, SQL, register, table  # noqa: F401


@register("op1_pii")
def op1_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@register("op2_decontamination", ORACLES["op2_decontamination"])
def op2_decontamination(spark, sf_dir):
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # One row per document and item, the best of texts that repeat a doc_id.
    return found.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("n_shingles", "n_shared", "containment"), "containment").alias("b")
    ).select("doc_id", "item_id", "b.*")


@register("op3_suffix_array_dedup", ORACLES["op3_suffix_array_dedup"])
def op3_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@register("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@register("op5_embedding_near_dedup", ORACLES["op5_embedding_near_dedup"])
def op5_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op6_bpe")
def op6_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@register("op7_quality")
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.Quality(docs, table(spark, sf_dir, "labels")).score(docs)


@register("op8_license_scan", ORACLES["op8_license_scan"])
def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.Toxicity(docs, table(spark, sf_dir, "labels")).score(docs)


@register("op10_ngram_jaccard_join", ORACLES["op10_ngram_jaccard_join"])
def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.NgramJoin(table(spark, sf_dir, "documents")).components()


@register("op11_conversation_repair", ORACLES["op11_conversation_repair"])
def op11_conversation_repair(spark, sf_dir):
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")))


@register("op12_spelling_variants", ORACLES["op12_spelling_variants"])
def op12_spelling_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spelling.variants(spelling.count_words(docs, spelling.LEAST_LENGTH, damage=97))


@register("op13_secret_scan")
def op13_secret_scan(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))
