"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the one before it wrote. Stages but the last return the columns of `documents`; models are
trained on the stage's own input with the labels of the folder. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm import packing, pii, quality, simhash, toxicity
from slotwise.llm.common import documents, sheltered, table
from slotwise.llm.defaults import (
    BYTE_TOKENIZER, MOST_BITS, PACK_END_ID, SEQUENCE_TOKENS, SHINGLE_WORDS, TOXIC_FROM, held_out,
)
from slotwise.sources.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or have too little content go."""
    inner, restore = sheltered(docs)
    field = quality.fit(inner, table(spark, sf_dir, "labels"))
    return restore(quality.judge(inner, field).where("q_kept"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that scores as toxic go."""
    inner, restore = sheltered(docs)
    net = toxicity.fit(inner, table(spark, sf_dir, "labels").where(~held_out()))
    return restore(toxicity.score(inner, net).where(F.col("t_score") < TOXIC_FROM))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one_per_group(docs, SHINGLE_WORDS, MOST_BITS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their tokens."""
    return packing.pack(docs, BYTE_TOKENIZER, PACK_END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_dedup),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

#: No twin: a trained field, a trained network and an iteration over links are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), "pipeline")
    return docs
