"""Token ids in wavelet-matrix shards: access, counting and occurrence lookup from one compressed file each."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from slotwise.llm.common import batch_slices, ids_and_texts
from slotwise.llm.library_tokens import library_tokens
from slotwise.sources.staging import stage

#: Tokens after which a task begins a new shard (a longer document stays in one).
SHARD_TOKENS = 2_000_000
#: Bits per block of a bit-plane; a block is unpacked alone and has its rank in the header.
BLOCK_BITS = 1 << 17

_MAGIC = b"WVM1"


def _narrow(width: int) -> type:
    """The narrowest type of ids of so many bits; planes move half the bytes with it."""
    return np.uint16 if width <= 16 else np.uint32


class WaveletMatrix:
    """A sequence of ids below 2^width as `width` bit-planes.

    The plane of the highest bit comes first; for the next plane the ids with a 0 go before those with a 1,
    both in their order. File: magic, width, number of ids, block size, then per plane the number
    of zeros, ranks (ones before each block), block sizes in the file; then all blocks, compressed.
    """

    def __init__(self, n: int, width: int, zeros: list[int], ranks: list[np.ndarray], blocks: list[list[bytes]],
                 block_bits: int):
        self.n, self.width, self.zeros, self.ranks, self.blocks = n, width, zeros, ranks, blocks
        self.block_bits = block_bits
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, width: int, block_bits: int = BLOCK_BITS) -> WaveletMatrix:
        press = zstandard.ZstdCompressor(level=1).compress
        if len(ids) and int(ids.max()) >> width:
            raise ValueError(f"an id needs more than {width} bits")
        row = np.ascontiguousarray(ids, _narrow(width))
        zeros, ranks, blocks = [], [], []
        for level in range(width):
            bits = (row & row.dtype.type(1 << (width - 1 - level))) != 0
            starts = range(0, len(row), block_bits)
            ones = np.array([np.count_nonzero(bits[s:s + block_bits]) for s in starts], np.int64)
            ranks.append(np.cumsum(ones) - ones)
            blocks.append([press(np.packbits(bits[s:s + block_bits]).tobytes()) for s in starts])
            zeros.append(len(row) - int(ones.sum()))
            row = np.concatenate([row[~bits], row[bits]])
        return cls(len(row), width, zeros, ranks, blocks, block_bits)

    def to_bytes(self) -> bytes:
        parts = [_MAGIC, struct.pack("<BQQ", self.width, self.n, self.block_bits)]
        for zeros, ranks, blocks in zip(self.zeros, self.ranks, self.blocks):
            parts += [struct.pack("<Q", zeros), ranks.astype("<u8").tobytes(),
                      np.array([len(b) for b in blocks], "<u4").tobytes()]
        return b"".join(parts + [b for blocks in self.blocks for b in blocks])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet shard")
        width, n, block_bits = struct.unpack_from("<BQQ", data, 4)
        at, count = 4 + struct.calcsize("<BQQ"), -(-n // block_bits)
        zeros, ranks, sizes = [], [], []
        for _ in range(width):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            ranks.append(np.frombuffer(data, "<u8", count, at + 8).astype(np.int64))
            sizes.append(np.frombuffer(data, "<u4", count, at + 8 + 8 * count))
            at += 8 + 12 * count
        blocks = []
        for own in sizes:
            ends = at + np.cumsum(own, dtype=np.int64)
            blocks.append([data[e - s:e] for e, s in zip(ends.tolist(), own.tolist())])
            at += int(own.sum())
        return cls(n, width, zeros, ranks, blocks, block_bits)

    def _bits(self, level: int, block: int) -> np.ndarray:
        size = min(self.block_bits, self.n - block * self.block_bits)
        packed = zstandard.ZstdDecompressor().decompress(self.blocks[level][block])
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=size)

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block and the ones before each of them; the last few blocks stay unpacked."""
        key = level, block
        if key not in self._open:
            if len(self._open) >= 4 * self.width:
                self._open.clear()
            bits = self._bits(level, block)
            self._open[key] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self._open[key]

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, inside = divmod(i, self.block_bits)
        return int(self.ranks[level][block] + self._block(level, block)[1][inside])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of the given value in a plane."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * self.block_bits - self.ranks[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * self.block_bits + int(np.flatnonzero(self._block(level, block)[0] == bit)[k - before[block]])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            block, inside = divmod(i, self.block_bits)
            bit = int(self._block(level, block)[0][inside])
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences before `end` lie below the last plane."""
        start = 0
        for level in range(self.width):
            a, b = self._rank(level, start), self._rank(level, end)
            if symbol >> (self.width - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of a symbol among the first `end` ids (default: all)."""
        if symbol >> self.width:
            return 0
        start, stop = self._range(symbol, self.n if end is None else min(end, self.n))
        return stop - start

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence (from 0)."""
        if not 0 <= k < self.rank(symbol):
            raise IndexError(k)
        i = self._range(symbol, self.n)[0] + k
        for level in reversed(range(self.width)):
            bit = symbol >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in their order, plane by plane from the last one up."""
        row = np.zeros(self.n, _narrow(self.width))
        for level in reversed(range(self.width)):
            blocks = [self._bits(level, b) for b in range(len(self.blocks[level]))]
            bits = np.concatenate(blocks).astype(bool) if blocks else np.zeros(0, bool)
            above = np.empty(self.n, row.dtype)
            above[~bits] = row[:self.zeros[level]]
            above[bits] = row[self.zeros[level]:] | row.dtype.type(1 << (self.width - 1 - level))
            row = above
        return row.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, width: int = 16) -> None:
    """Encode whole texts in ascending doc_id order, close each with `end_id`, and write wavelet shards.

    A shard is a Parquet file of one row: its place (task, part), its documents (doc_ids, doc_tokens) and the
    wavelet file (payload), so that Spark's commit protocol guards it against lost executors on any store.
    Null doc_ids come first, rows of the same doc_id in the order of their texts; a null or empty text
    is the end token alone; other columns are ignored. An empty table gives no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens(tokenizer_path, False, lower_case=True)
        task, part = TaskContext.get().partitionId(), 0
        names, lengths, ids, held, id_type = [], [], [], 0, None

        def shard() -> pa.RecordBatch:
            payload = WaveletMatrix.build(np.concatenate(ids), width).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([part], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([names], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())],
                ["task", "part", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        for batch in batch_slices(batches):
            id_type = batch.schema.field("doc_id").type
            flat, counts = tokens.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids.append(np.insert(flat, ends, end_id))
            names += batch.column("doc_id").to_pylist()
            lengths += (counts + 1).tolist()
            held += len(ids[-1])
            if held >= SHARD_TOKENS:
                yield shard()
                part += 1
                names, lengths, ids, held = [], [], [], 0
        if names:
            yield shard()

    rows = ids_and_texts(docs).withColumn("__tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie", "text").drop("__tie")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"task long, part long, n_tokens long, doc_ids array<{id_type}>, doc_tokens array<long>, payload binary"
    ordered.mapInArrow(run, schema).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Manifest: task, part, n_tokens, shard_start (ids of all shards before).

    Parts are summed within their task and tasks over their totals, so no window holds all shards.
    """
    manifest = spark.read.parquet(path).select("task", "part", "n_tokens")
    in_task = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over_tasks = Window.partitionBy(F.lit(1)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("task").agg(F.sum("n_tokens").alias("total")).select(
        "task", F.coalesce(F.sum("total").over(over_tasks), F.lit(0)).alias("task_start"))
    starts = manifest.join(totals, "task").select(
        "task", "part", "n_tokens",
        (F.col("task_start") + F.coalesce(F.sum("n_tokens").over(in_task), F.lit(0))).alias("shard_start"))
    # Staged, so that Spark knows its size and need not shuffle the shards themselves to join it.
    return stage(starts, "shard-starts")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the shards: doc_id, start (ids of all documents before it), n_tokens, tokens (little-endian
    unsigned 32-bit ids). Each shard is decoded plane by plane in one task."""
    shards = spark.read.parquet(path)
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = WaveletMatrix.from_bytes(batch.column("payload")[i].as_py()).decode().astype("<u4")
                counts = np.array(batch.column("doc_tokens")[i].as_py(), np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                tokens = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(starts + batch.column("shard_start")[i].as_py()),
                     pa.array(counts), pa.array(tokens, pa.binary())],
                    ["doc_id", "start", "n_tokens", "tokens"]).slice(0, n)

    starts = shard_starts(spark, path).select("task", "part", "shard_start")
    return shards.join(starts, ["task", "part"]).select("shard_start", "doc_ids", "doc_tokens", "payload").mapInArrow(
        run, f"doc_id {id_type}, start long, n_tokens long, tokens binary")


def occurrences(spark: SparkSession, path: str, symbol: int, most_per_shard: int = 0) -> DataFrame:
    """Per shard: task, part, n_occurrences of an id, and the places (in all ids) of the first few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column("payload")[i].as_py())
                count, base = matrix.rank(symbol), batch.column("shard_start")[i].as_py()
                places = [base + matrix.select(symbol, k) for k in range(min(count, most_per_shard))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("task").slice(i, 1), batch.column("part").slice(i, 1),
                     pa.array([count], pa.int64()), pa.array([places], pa.list_(pa.int64()))],
                    ["task", "part", "n_occurrences", "places"])

    starts = shard_starts(spark, path).select("task", "part", "shard_start")
    return spark.read.parquet(path).join(starts, ["task", "part"]).select(
        "task", "part", "shard_start", "payload").mapInArrow(
        run, "task long, part long, n_occurrences long, places array<long>")
