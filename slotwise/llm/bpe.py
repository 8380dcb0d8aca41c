"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves pre-tokens that are whole vocabulary entries; the others are
merged by a heap over linked bytes. Resolved pre-tokens are remembered per worker, within a bound.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from slotwise.llm.common import id_field, ids_and_texts, list_array, text_slices, without_cycle_search

#: Pre-tokens that a worker remembers; beyond it (but for the batch at hand) it forgets the later half.
MEMO_ENTRIES = 400_000


class MinimalPerfectHash:
    """Maps n distinct byte strings to 0..n-1 without gaps by hash and displacement.

    Keys fall into n / 2 buckets. Large buckets first, each gets the smallest displacement that sends its
    keys to free slots; a bucket of one key takes any free slot, noted as a negative number. With so many buckets an
    eighth of the keys is alone in theirs, so free slots stay easy to find to the end.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            members[xxhash.xxh64_intdigest(key) % self.buckets].append(i)
        self.displacement = [0] * self.buckets
        self.slot_of_key = [0] * n
        free = bytearray(b"\x01") * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        lone: list[int] = []
        for b in order:
            if len(members[b]) < 2:
                if members[b]:
                    lone.append(b)
                continue
            seed = 1
            while True:
                slots = [xxhash.xxh64_intdigest(keys[i], seed) % n for i in members[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                seed += 1
            self.displacement[b] = seed
            for i, s in zip(members[b], slots):
                self.slot_of_key[i] = s
                free[s] = 0
        unused = (s for s in range(n) if free[s])
        for b, s in zip(lone, unused):
            self.displacement[b] = -1 - s
            self.slot_of_key[members[b][0]] = s

    def slot(self, key: bytes) -> int:
        """The key's slot; a string that is no key gets the slot of another one."""
        d = self.displacement[xxhash.xxh64_intdigest(key) % self.buckets]
        return -1 - d if d < 0 else xxhash.xxh64_intdigest(key, d) % self.n


class ByteBpe:
    """Encoder and decoder for a rank file: lines of base64 bytes and rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.id_at = [0] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of_key):
            self.key_at[slot], self.id_at[slot] = key, ranks[key]
        self.bytes_of = {i: key for key, i in ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self.memo = PieceMemo(self.encode_pieces, MEMO_ENTRIES)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines)})

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many belong to each pre-token."""
        return joined([self.encode_piece(p.encode()) for p in pieces])

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the hash answers for whole entries, the heap merges the rest."""
        slot = self.hash.slot(piece)
        if self.key_at[slot] == piece:
            return [self.id_at[slot]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no neighbours form an entry.

        `end[i]` is the end of the part that starts at byte i, `before[i]` the start of the part before it.
        A heap entry counts only if both of its parts still end where they did.
        """
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, mid, right = heapq.heappop(heap)
            if end[left] != mid or mid >= n or end[mid] != right:
                continue
            end[left] = right
            end[mid] = 0  # no part starts here any longer
            if right < n:
                before[right] = left
                if (rank := ranks.get(piece[left:end[right]])) is not None:
                    heapq.heappush(heap, (rank, left, right, end[right]))
            previous = before[left]
            if previous >= 0 and (rank := ranks.get(piece[previous:right])) is not None:
                heapq.heappush(heap, (rank, previous, left, right))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many belong to each text."""
        with without_cycle_search():
            return self.memo.encode([self.pattern.findall(t) for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


class PieceMemo:
    """Ids of text pieces, remembered in flat arrays so that a batch is put together by numpy."""

    def __init__(self, encode_pieces, most: int):
        self.encode_pieces, self.most = encode_pieces, most

        self.codes: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.used = 0

    def keep(self, entries: int) -> None:
        """Forget all but the first entries: frequent pieces come early."""
        self.codes = dict(islice(self.codes.items(), entries))
        self.used = int(self.ends[len(self.codes)])

    def add(self, pieces: list[str]) -> None:
        ids, lengths = self.encode_pieces(pieces)
        first = len(self.codes)
        if (need := first + len(pieces) + 1) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(need, np.int64)])
        if (need := self.used + int(lengths.sum())) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        self.ends[first + 1: first + 1 + len(pieces)] = self.used + np.cumsum(lengths)
        self.flat[self.used: need] = ids
        self.used = need
        self.codes.update(zip(pieces, range(first, first + len(pieces))))

    def encode(self, pieces_of: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, given as lists of pieces, and how many belong to each text."""
        pieces = list(chain.from_iterable(pieces_of))
        found = list(map(self.codes.get, pieces))
        new = dict.fromkeys(p for p, code in zip(pieces, found) if code is None)
        if new:
            if len(self.codes) + len(new) > self.most:
                self.keep(self.most // 2)
                new = dict.fromkeys(p for p in pieces if p not in self.codes)
                found = [None] * len(pieces)
            self.add(list(new))
            codes = self.codes
            found = [codes[p] if code is None else code for p, code in zip(pieces, found)]
        code = np.array(found, np.int64)
        start = self.ends[code]
        length = self.ends[code + 1] - start
        shift = np.cumsum(length)
        total = int(shift[-1]) if len(shift) else 0
        ids = self.flat[np.arange(total) + np.repeat(start - (shift - length), length)]
        bound = np.concatenate([[0], shift])[np.cumsum([0, *map(len, pieces_of)])]
        return ids, np.diff(bound)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe.load(path)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document: doc_id, its token ids, and the bytes that these ids decode to.

    `docs` needs doc_id and text; other columns, whatever their names, are ignored. A null or empty text
    has no ids and decodes to no bytes; a null doc_id and repeated rows are kept, a row each. No shuffle:
    each scan task encodes its own texts, whole, about two million characters at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocabulary_path)
        for batch, texts in text_slices(batches):
            ids, lengths = bpe.encode_texts(texts)
            bounds = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            listed = ids.tolist()
            decoded = [bpe.decode(listed[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), list_array(ids, lengths), pa.array(decoded, pa.binary())],
                ["doc_id", "ids", "decoded"])

    return ids_and_texts(docs).mapInArrow(run, f"{id_field(docs)}, ids array<int>, decoded binary")


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document: doc_id and its number of tokens (null or empty text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocabulary_path)
        for batch, texts in text_slices(batches):
            _, lengths = bpe.encode_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return ids_and_texts(docs).mapInArrow(run, f"{id_field(docs)}, n_tokens long")
