"""Registered queries of the training-data operators and their SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotwise.llm import (
    bpe, hard_negatives, packing, passages, pii, prefix_trie, projection, quality, sharding, simhash, token_counts, toxicity,
    wavelet,
)
from slotwise.llm.common import documents, importable_by_workers, table
from slotwise.llm.defaults import (
    ANCHOR_EVERY, BYTE_RANKS, BYTE_TOKENIZER, GOOD_FROM, MOST_BITS, PACK_END_ID, SEQUENCE_TOKENS, SHINGLE_WORDS, TOXIC_FROM,
    WORD_TOKENIZER, held_out, held_out_quality, searched_label,
)
from slotwise.llm.twins import LLM_ORACLES  # noqa: F401
from slotwise.sources.staging import stage, staging_path


def _hex_of_ids(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), BYTE_RANKS).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), _hex_of_ids("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Staged, since the totals read it twice and the texts are to be encoded once.
    histogram = stage(token_counts.length_histogram(documents(spark, sf_dir), BYTE_RANKS), "lengths")
    return token_counts.context_totals(histogram)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_TOKENIZER, PACK_END_ID, SEQUENCE_TOKENS).select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "wavelet-shards")
    wavelet.write_shards(documents(spark, sf_dir), WORD_TOKENIZER, end_id=2, path=path)
    return wavelet.read_documents(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(documents(spark, sf_dir), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out().alias("held_out"), F.col("t_score").alias("score"),
        (F.col("t_score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir), ["doc_id"]))


def op8_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), field).select(
        "doc_id", *(F.col(f"q_{c}").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "content_share")))


def op9_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.linked_vectors(table(spark, sf_dir, "embeddings"), least_cosine=0.9)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir), SHINGLE_WORDS, MOST_BITS).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = passages.fit(docs, table(spark, sf_dir, "labels").where(~held_out_quality()))
    return passages.score(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out_quality().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= GOOD_FROM).cast("int").alias("predicted"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), searched_label(), F.col("vec_id") % ANCHOR_EVERY == 0)


LLM_QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_wavelet_shards": op4_wavelet_shards,
    "op5_label_propagation": op5_label_propagation,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_line_field": op8_line_field,
    "op9_projection_passes": op9_projection_passes,
    "op10_simhash": op10_simhash,
    "op11_passage_attention": op11_passage_attention,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

LLM_QUERIES = {name: importable_by_workers(query) for name, query in LLM_QUERIES.items()}
