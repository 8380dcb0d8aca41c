"""What several operators share: reading tables, batches of texts, global order without one big task."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from slotwise.sources.staging import stage

#: Python works on this many characters of text at a time (one longer text is one piece of work).
SLICE_CHARS = 2_000_000


def importable_by_workers(query):
    """A query whose Python workers find this package, wherever the driver was started.

    The folder must be the same on all machines, as for any package that is not shipped with the application.
    """
    root = str(Path(__file__).resolve().parents[2])

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, root])
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text is an empty one."""
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """doc_id, text and one column with all others, so that no column of an operator clashes with them; and what
    gives a frame made from these rows the columns of `docs` again."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inside = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(None)
    inner = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), inside.alias("others"))

    def restore(rows: DataFrame) -> DataFrame:
        place = {c: F.col(f"others.c{i}").alias(c) for i, c in enumerate(others)}
        return rows.select(*(place.get(c, F.col(c)) for c in docs.columns))

    return inner, restore


def without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without the columns that an operator is about to add."""
    new = {n.lower() for n in names}
    return docs.drop(*(c for c in docs.columns if c.lower() in new))


def id_field(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """Python's search for cycles is off: work on many small lists makes none and would be slowed down."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def give_back_memory() -> None:
    """What a task no longer uses goes back to the system: the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def batch_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches with at most SLICE_CHARS characters of text each, or one longer text."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)
                        [texts.offset: texts.offset + len(texts) + 1])
        start = taken = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and taken + size > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += size
        if start < len(sizes):
            yield batch.slice(start)
    give_back_memory()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The parts that batch_slices yields, each with its texts as a list."""
    for part in batch_slices(batches, column):
        yield part, part.column(column).to_pylist()


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list per row from one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def spread_cumsum(df: DataFrame, by: list[str], order: list[str], weight: Column, out: str, salt: Column,
                  buckets: int = 64) -> DataFrame:
    """Running total of `weight` before each row, per group `by`, in a fixed order that starts with a hash bucket.

    A group is cut into buckets by `salt`, each bucket is summed on its own and gets the total of the
    buckets before it, so no task holds a whole group. Totals of buckets are `buckets` rows per group.
    """
    cut = df.withColumn("__bucket", F.pmod(salt, F.lit(buckets)).cast("int")).withColumn("__weight", weight)
    totals = cut.groupBy(*by, "__bucket").agg(F.sum("__weight").alias("__total"))
    # Without groups the totals are one row per bucket.
    before = Window.partitionBy(*by or [F.lit(1)]).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"__of_{k}" for k in (*by, "__bucket")}
    bases = totals.select(
        *(F.col(k).alias(n) for k, n in names.items()),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = cut.join(bases, on).drop(*names.values())
    own = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum("__weight").over(own), F.lit(0))).drop(
        "__bucket", "__weight", "__base")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_0: int, most_1: int, most_chars: int,
                    ) -> list[tuple[str, int]]:
    """Up to most_0 and most_1 texts of label 0 and 1, picked by a hash of doc_id, in a fixed order.

    Rows with a null id or label, ids with both labels, blank texts and those over most_chars characters are
    left out before any are picked. The ids are picked first, so only a bounded number of texts moves or reaches
    the driver.
    """
    short = docs.select("doc_id", "text").where((F.length("text") <= most_chars) & (F.length(F.trim("text")) > 0))
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    # Staged, since each label reads it. Repeated ids are one row before they meet the labels.
    named = stage(named.join(short.select("doc_id").distinct(), "doc_id"), "labelled")
    picked = None
    for value, most in ((0, most_0), (1, most_1)):
        own = named.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    rows = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(r.text, value) for value in (0, 1) for r in rows if r.label == value]
