"""Production parameters that queries and pipeline share."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, functions as F

BYTE_RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = tokenizer_path("byte_bpe_50k.json")
WORD_TOKENIZER = tokenizer_path("word_bpe_49k.json")

#: Documents with this toxicity score or more count as toxic.
TOXIC_FROM = 0.3
#: Documents with this quality score or more count as good.
GOOD_FROM = 0.3
#: Vectors whose id is divisible by this are anchors.
ANCHOR_EVERY = 50
#: Words per shingle and most differing bits of near-duplicates.
SHINGLE_WORDS, MOST_BITS = 3, 2
SEQUENCE_TOKENS, PACK_END_ID = 1024, 0


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose toxicity labels are kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def held_out_quality(doc_id: str = "doc_id") -> Column:
    """Rows whose quality labels are kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def searched_label() -> Column:
    """Every seventh vector has the next of ten labels."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
