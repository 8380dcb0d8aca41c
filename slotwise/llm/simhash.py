"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from slotwise.llm.common import sheltered, text_slices
from slotwise.llm.components import connected_components
from slotwise.operators.joins import salted_join
from slotwise.sources.staging import stage

SEED = 42
#: Postings up to this length give pairs; longer ones are split by more bytes, then linked by `_neighbourhood_links`.
LONG_POSTING = 64


def fingerprint_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the bits that are set in over half of its hashes; without hashes 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    major = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(major).view("<u8").ravel()
    return out


def shingle_hashes(text: str, words_per_shingle: int) -> list[int]:
    """XXH64 of each run of words; A-Z become small, words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-words_per_shingle] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1:].tolist())]


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """The rows of `docs` (any columns, a null text is empty) with a 64-bit fingerprint (signed long).

    A text without words has fingerprint 0. The new column's name must be free.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            hashes = [shingle_hashes(t or "", words_per_shingle) for t in texts]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter(chain.from_iterable(hashes), np.uint64, int(counts.sum()))
            marks = pa.array(fingerprint_of(flat, counts).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def index_places(max_bits: int) -> tuple[list[int], int]:
    """Places of the index, as masks of whole bytes, and how many of them two fingerprints share at least.

    Up to 3 bits: the 14 sets of four byte positions whose numbers cancel out under exclusive or. Every position is
    in 7 of them, every two in 3, every three in one, so 0, 1, 2 or 3 bytes that differ leave at least 14, 7, 3 or 1
    places. More bits: of the 8 bytes in max_bits + 2 groups every two groups; two groups at least are the same.
    """
    if max_bits <= 3:
        sets = [four for four in combinations(range(8), 4) if four[0] ^ four[1] ^ four[2] ^ four[3] == 0]
        return [sum(0xFF << 8 * i for i in four) for four in sets], (14, 7, 3, 1)[max_bits]
    groups = [sum(0xFF << 8 * int(b) for b in part) for part in np.array_split(np.arange(8), max_bits + 2)]
    return [a | b for a, b in combinations(groups, 2)], 1


def _parts_of_place(mask: int, max_bits: int) -> list[int]:
    """The place with enough further bytes that two fingerprints of a posting agree on one such part at least."""
    others = [0xFF << 8 * i for i in range(8) if not mask >> 8 * i & 1]
    return [mask | sum(more) for more in combinations(others, max(0, len(others) - max_bits))]


def _neighbourhood_links(marks: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints by the values up to half of `max_bits` bits away from them, rounded up.

    Two fingerprints within max_bits bits have such a value in common, and few fingerprints (65 for one bit) can share
    one, so the lists are short whatever the data. With an odd max_bits those that share a value may be a bit too far
    apart, so each value's few members are compared.
    """
    radius = -(-max_bits // 2)
    near = F.array(F.col("fingerprint"), *(
        F.col("fingerprint").bitwiseXOR(F.lit(_signed(sum(1 << b for b in bits))))
        for r in range(1, radius + 1) for bits in combinations(range(64), r)))
    shared = marks.select("fingerprint", F.explode(near).alias("value")).groupBy("value").agg(
        F.collect_list("fingerprint").alias("own")).where(F.size("own") > 1)
    if max_bits % 2 == 0:
        return shared.select(F.array_min("own").alias("src"), F.explode("own").alias("dst")).where("src <> dst")
    one = shared.select("own", F.explode("own").alias("src"))
    return one.select("src", F.explode("own").alias("dst")).where(
        (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits))


def _postings(marks: DataFrame, masks: Column) -> DataFrame:
    """Rows place, part, bytes, fingerprint and how many fingerprints the posting holds, if more than one.

    marks: fingerprint, and `masks` an array of (place, part, mask).
    """
    index = marks.select("fingerprint", F.explode(masks).alias("p")).select(
        "p.place", "p.part", F.col("fingerprint").bitwiseAND(F.col("p.mask")).alias("bytes"), "fingerprint")
    own = ["place", "part", "bytes"]
    lengths = stage(index.groupBy(*own).agg(F.count(F.lit(1)).alias("length")).where("length > 1"), "lengths")
    return stage(salted_join(index, lengths, own), "postings")


def fingerprint_links(marks: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (src, dst) that connect distinct fingerprints as all pairs within `max_bits` (0 to 6) bits would.

    Each fingerprint enters the index once per place with the bytes found there. Pairs that share a posting
    are tallied by place; those that reach the guaranteed minimum of shared places (3 of 14 for 2 bits) are verified bit
    by bit. A posting over LONG_POSTING is first split by further bytes (of which a pair shares one choice at least);
    a pair counts once per place. What is still over LONG_POSTING would give too many pairs, so its members are linked
    through their bit neighbourhoods: a pair that is not fully tallied has both ends among them, so no link is
    lost, in rows proportional to the members.
    """
    if not 0 <= max_bits <= 6 or max_bits > 3 and max_bits % 2:
        raise ValueError("max_bits must be 0 to 4 or 6")
    places, least = index_places(max_bits)

    def listed(numbered: list[tuple[int, int, int]]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("place"), F.lit(j).alias("part"), F.lit(_signed(m)).cast("long").alias("mask"))
                         for i, j, m in numbered))

    whole = _postings(marks, listed([(i, 0, m) for i, m in enumerate(places)]))
    parts = listed([(i, j, m) for i, place in enumerate(places) for j, m in enumerate(_parts_of_place(place, max_bits))])
    long_ones = whole.where(F.col("length") > LONG_POSTING).groupBy("fingerprint").agg(F.collect_set("place").alias("long"))
    split = _postings(long_ones, F.filter(parts, lambda p: F.array_contains("long", p["place"])))
    pairs = None
    for postings in (whole, split):
        short = postings.where(F.col("length") <= LONG_POSTING)
        a = short.select("place", "part", "bytes", F.col("fingerprint").alias("src"))
        b = short.select("place", "part", "bytes", F.col("fingerprint").alias("dst"))
        own = a.join(b, ["place", "part", "bytes"]).where("src < dst").select("src", "dst", "place")
        pairs = own if pairs is None else pairs.unionByName(own)
    tally = pairs.groupBy("src", "dst").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, place)"))).alias("shared"))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    found = tally.where((F.col("shared") >= least) & close).select("src", "dst")
    crowded = split.where(F.col("length") > LONG_POSTING).select("fingerprint").distinct()
    return found.unionByName(_neighbourhood_links(crowded, max_bits)).distinct()


def near_duplicates(marks: DataFrame, max_bits: int = 2) -> DataFrame:
    """Groups of distinct fingerprints: fingerprint, component (the same for all that links connect)."""
    linked = connected_components(fingerprint_links(marks, max_bits))
    return marks.join(linked, marks["fingerprint"] == linked["node"], "left").select(
        marks["fingerprint"], F.coalesce("component", "fingerprint").alias("component"))


def simhash_groups(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Per document: doc_id, fingerprint (signed long), component_id (smallest doc_id of its group).

    A null text is empty; texts without words share fingerprint 0 and so one group. Rows with a null
    doc_id are kept; their group has the smallest other doc_id, null if there is none. Repeated rows
    stay. Only doc_id and text are read. An empty table gives no rows. Rows of one fingerprint are summed
    up before anything is joined, and the last join, from groups to rows, is salted.
    """
    marked = stage(fingerprints(docs.select("doc_id", "text"), words_per_shingle).drop("text"), "marked")
    marks = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    groups = marks.join(near_duplicates(marks.select("fingerprint"), max_bits), "fingerprint")
    smallest = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stage(groups.join(smallest, "component").select("fingerprint", "component_id"), "named")
    return salted_join(marked, named, ["fingerprint"]).select("doc_id", "fingerprint", "component_id")


def keep_one_per_group(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents with one row of each near-duplicate group, all columns as they were, whatever their names.

    The row with the smallest doc_id stays (rows without one come last); of several rows with this doc_id
    one stays. An empty table gives no rows. Fingerprints are computed once and staged with the rows, which get numbers
    of their own. The rows that go are the few: they are taken out by an anti-join, so where they fit a
    broadcast the texts stay in place.
    """
    inner, restore = sheltered(docs)
    marked = stage(fingerprints(inner.withColumn("row", F.monotonically_increasing_id()), words_per_shingle), "marked")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    marks = stage(marked.groupBy("fingerprint").agg(F.min(first).alias("first")), "fingerprints")
    groups = stage(marks.join(near_duplicates(marks.select("fingerprint"), max_bits), "fingerprint"), "groups")
    stays = groups.groupBy("component").agg(F.min("first").alias("of_group"))
    stays = stage(groups.join(stays, "component").select("fingerprint", F.col("of_group.row").alias("stays")), "stays")
    goes = stage(salted_join(marked.select("row", "fingerprint"), stays, ["fingerprint"]).where("row <> stays").select("row"), "goes")
    return restore(marked.join(goes, "row", "left_anti"))
