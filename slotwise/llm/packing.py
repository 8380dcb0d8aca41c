"""Harmonic packing of documents into sequences of a fixed capacity.

A document's tokens are cut into pieces: as many whole sequences as fit, then pieces of exactly 1/2, 1/4, ...
of the capacity down to SMALLEST, then a tail below SMALLEST. Pieces of length l belong to the class k
with capacity/(k+1) < l <= capacity/k, and every bin of class k takes exactly k pieces. The exact classes
fill their bins without padding; a tail class wastes less than one tail per bin. At the end of a task's
rows the tails of unfinished bins are cut to powers of two as well, and unfinished bins of an exact class
are dealt out in runs of a power of two pieces, which need no padding. Every task packs its own rows, so
there is no shuffle, and nothing is held but the unfinished bins: at most one sequence per class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slotwise.llm.common import batch_slices, id_field, ids_and_texts
from slotwise.llm.library_tokens import library_tokens

#: Shortest exact piece; what is left of a document below it stays whole if its class fills a bin.
SMALLEST = 64


class Bins:
    """Unfinished bins of one task. A piece is (document, start, length)."""

    def __init__(self, capacity: int, first_sequence: int):
        if capacity < SMALLEST or capacity & (capacity - 1):
            raise ValueError(f"the capacity must be a power of two of at least {SMALLEST}")
        self.capacity, self.next_sequence = capacity, first_sequence
        self.exact: dict[int, list[tuple]] = {}
        self.tails: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Deal a bin's pieces out as one sequence: pieces with sequence and offset."""
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_sequence, offset)
            offset += piece[2]
        self.next_sequence += 1

    def add_exact(self, document, start: int, length: int) -> Iterator[tuple]:
        """Cut a length into powers of two and put each one into the bin of its class."""
        while length:
            part = min(self.capacity, 1 << (length.bit_length() - 1))
            own = self.exact.setdefault(part, [])
            own.append((document, start, part))
            if len(own) * part == self.capacity:
                yield from self.close(own)
                own.clear()
            start, length = start + part, length - part

    def add(self, document, length: int) -> Iterator[tuple]:
        tail = length % SMALLEST
        yield from self.add_exact(document, 0, length - tail)
        if tail:
            k = self.capacity // tail
            own = self.tails.setdefault(k, [])
            own.append((document, length - tail, tail))
            if len(own) == k:
                yield from self.close(own)
                own.clear()

    def finish(self) -> Iterator[tuple]:
        for k in sorted(self.tails):
            for piece in self.tails[k]:
                yield from self.add_exact(*piece)
        for part in sorted(self.exact):
            own = self.exact[part]
            while own:
                run = 1 << (len(own).bit_length() - 1)
                yield from self.close(own[:run])
                del own[:run]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Tokenize whole texts, close each with `end_id`, and pack them into sequences.

    Returns a row per piece: doc_id, start (tokens of its document before it), length, doc_tokens (with the
    end token), sequence_id, offset (place in the sequence, gapless from 0), tokens (little-endian
    unsigned 32-bit ids). Sequences whose length is no power of two are to be padded to the capacity.
    A null or empty text is the end token alone; a null doc_id and repeated rows are documents of their
    own; other columns are ignored. sequence_id starts at task number * 2^33 and counts up, so a task that
    runs again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens(tokenizer_path, True)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        ready: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows = [((doc, start, length, doc_ids, seq, offset)) for (doc, doc_ids), start, length, seq, offset in ready]
            columns = list(zip(*rows)) if rows else [()] * 6
            binary = [ids[start:start + length].tobytes() for _, start, length, ids, _, _ in rows]
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array([len(ids) for ids in columns[3]], pa.int64()), pa.array(columns[4], pa.int64()),
                 pa.array(columns[5], pa.int64()), pa.array(binary, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"])
            ready.clear()
            return out

        id_type = None
        for batch in batch_slices(batches):
            id_type = batch.schema.field("doc_id").type
            ids, lengths = tokens.encode(batch.column("text"))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[i]:bounds[i + 1]], end_id).astype("<u4")
                ready.extend(bins.add((doc, own), len(own)))
            if ready:
                yield flush()
        ready.extend(bins.finish())
        if ready:
            yield flush()

    schema = (f"{id_field(docs)}, start long, length long, doc_tokens long, sequence_id long, offset long, "
              "tokens binary")
    return ids_and_texts(docs).mapInArrow(run, schema)
