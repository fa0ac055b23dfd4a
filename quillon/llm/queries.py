"""The queries opN_<name>: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.llm import html_extract, oracles, pii, positional_index, ppm_language, quality_rules, ring_sharding, signature_trees, source_mixing, suffix_dedup, token_counts

QUERIES: dict = {}
ORACLES = {
    "op1_quality_rules": oracles.OP1,
    "op2_source_mixing": oracles.OP2,
    "op5_ngram_jaccard_join": oracles.OP5,
    "op7_pii_disclosure": oracles.OP7,
    "op8_positional_decontamination": oracles.OP8,
    "op9_suffix_array_dedup": oracles.OP9,
}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query
def op1_quality_rules(spark, d):
    judged = quality_rules.judge(_table(spark, d, "documents"), _table(spark, d, "labels"))
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))


@_query
def op2_source_mixing(spark, d):
    mixed = source_mixing.mix(_table(spark, d, "documents"), narrow=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op3_token_attribution(spark, d):
    counts = token_counts.token_counts(_table(spark, d, "documents"))
    return counts.withColumn("n_sections", F.size("section_tokens").cast("long"))


@_query
def op4_ring_sharding(spark, d):
    docs = _table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"))
    placed = ring_sharding.assign(rows, 16, text="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query
def op5_ngram_jaccard_join(spark, d):
    groups = signature_trees.jaccard_groups(_table(spark, d, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@_query
def op6_ppm_language_id(spark, d):
    docs = _table(spark, d, "documents")
    model = ppm_language.train(docs)
    scored = ppm_language.identify(docs.withColumn("_id", F.struct("doc_id", ppm_language.held_out("doc_id").alias("held_out"))), model, "_id")
    return scored.select("_id.doc_id", "_id.held_out", "lang_pred", "score")


@_query
def op7_pii_disclosure(spark, d):
    return pii.digest(pii.detect(_table(spark, d, "documents")))


@_query
def op8_positional_decontamination(spark, d):
    return positional_index.digest(positional_index.decontaminate(_table(spark, d, "documents"), _table(spark, d, "benchmark")))


@_query
def op9_suffix_array_dedup(spark, d):
    spans = suffix_dedup.removed_spans(_table(spark, d, "documents"))
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op10_html_extraction(spark, d):
    return html_extract.extract(_table(spark, d, "pages"))
