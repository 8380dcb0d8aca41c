"""Ids from the tokenizers library, asked once per distinct piece of text and worker.

The pre-tokenizers of both files never join text across the start of a white-space run, so a text is cut
there, each distinct piece is encoded by the library, and the ids are put together again. Texts are cut and their
pieces numbered by Arrow, so that Python meets the distinct pieces of a slice only. Texts that hold unusual
white space or the beginning of a special token's name are asked whole or run by run.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from slotwise.llm.bpe import joined
from slotwise.llm.common import without_cycle_search

#: Pieces that a worker remembers; beyond it (but for the slice at hand) it forgets the later half.
MEMO_ENTRIES = 1_500_000
#: Pieces that the library encodes at a time.
CALL_PIECES = 8_192

# Control characters and spaces that programs may class differently, and the mark of exact pieces; the names of
# special tokens begin with "<|" and are ids of their own wherever they stand.
_ODD = "[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|<\\|"
_UNEVEN = r"[\t\r\f\v]|[ \n][ \n]"
_RUN = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
# A piece with this mark is encoded as it stands; any other one follows a space or starts with a line end.
_EXACT = "\x00"
# A comma or full stop after anything but a plain letter or digit might belong to the mark before it (the dotted capital
# I becomes a letter and a mark in lower case).
_AFTER_MARK = "[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,][ \n]"


def pieces_of_runs(text: str) -> list[str]:
    """Pieces of a text with any plain white space."""
    return [_EXACT + run for run in _RUN.findall(text)]


def piece_hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of an Arrow array without nulls: sums over (place, byte), then mixed."""
    pieces = pieces.cast(pa.large_string())
    n = len(pieces)
    _, offsets, content = pieces.buffers()
    ends = np.frombuffer(offsets, np.int64)[pieces.offset:pieces.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8)[ends[0]:ends[-1]] if content is not None else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(ends[:-1] - ends[0], sizes).astype(np.uint64)
    mixed = (place << np.uint64(8)) + data + np.uint64(1)
    out = []
    for odd in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)):
        part = mixed * odd
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        total = np.zeros(n, np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            total[full] = np.add.reduceat(part, (ends[:-1] - ends[0])[full])
        total = (total + sizes.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        out.append(total ^ (total >> np.uint64(31)))
    return out[0], out[1]


class PieceTable:
    """Ids of text pieces, remembered under 128 bits of hash in flat arrays, so that numpy looks up a whole slice."""

    def __init__(self, encode_pieces, most: int):
        self.encode_pieces, self.most = encode_pieces, most
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # in the order of the first hash
        self.place = np.zeros(0, np.int64)  # of a piece among all that are remembered
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def keep(self, entries: int) -> None:
        """Forget all but the first entries: frequent pieces come early."""
        kept = self.place < entries
        self.first, self.second, self.place = self.first[kept], self.second[kept], self.place[kept]

    def add(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces, after those that are remembered."""
        ids, lengths = joined(self.encode_pieces(pieces))
        held = len(self.place)
        used = int(self.ends[held])
        if (need := held + len(pieces) + 1) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(need, np.int64)])
        if (need := used + len(ids)) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        self.ends[held + 1:held + 1 + len(pieces)] = used + np.cumsum(lengths)
        self.flat[used:need] = ids

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces; unknown ones are encoded first."""
        first, second = piece_hashes(pieces)
        at = np.minimum(np.searchsorted(self.first, first), max(len(self.first) - 1, 0))
        met = (self.first[at] == first) & (self.second[at] == second) if len(self.first) else np.zeros(len(first), bool)
        new = np.flatnonzero(~met)
        if len(new) and len(self.place) + len(new) > self.most and len(self.place) > self.most // 2:
            self.keep(self.most // 2)
            return self.numbers(pieces)
        out = np.empty(len(first), np.int64)
        out[met] = self.place[at[met]]
        if len(new):
            out[new] = len(self.place) + np.arange(len(new))
            self.add(pieces.take(pa.array(new)).to_pylist())
            new = new[np.argsort(first[new], kind="stable")]
            into = np.searchsorted(self.first, first[new])
            self.first, self.second, self.place = (
                np.insert(old, into, more) for old, more in
                ((self.first, first[new]), (self.second, second[new]), (self.place, out[new])))
        return out

    def put_together(self, code: np.ndarray, pieces_per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, given as places of their pieces, and how many belong to each text."""
        start = self.ends[code]
        length = self.ends[code + 1] - start
        shift = np.cumsum(length)
        total = int(shift[-1]) if len(shift) else 0
        ids = self.flat[np.arange(total) + np.repeat(start - (shift - length), length)]
        bound = np.concatenate([[0], shift])[np.concatenate([[0], np.cumsum(pieces_per_text)])]
        return ids, np.diff(bound)


class LibraryTokens:
    def __init__(self, path: str, space_counts: bool, lower_case: bool = False):
        """space_counts: white space belongs to the token after it; lower_case: case makes no difference."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.space_counts, self.lower_case = space_counts, lower_case
        self.memo = PieceTable(self.encode_pieces, MEMO_ENTRIES)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece."""
        if self.space_counts:
            plain = [p[1:] if p[0] == _EXACT else p if p[0] == "\n" else " " + p for p in pieces]
        else:
            plain = [p[1:] if p[0] == _EXACT else p for p in pieces]
        return [e.ids for i in range(0, len(plain), CALL_PIECES)
                for e in self.tokenizer.encode_batch_fast(plain[i:i + CALL_PIECES], add_special_tokens=False)]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of the even texts, how many each has, and which texts are even.

        A comma or full stop between a word and white space becomes a piece, so that the word is met more often.
        """
        even = pc.invert(pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring_regex(texts, _AFTER_MARK)))
        if self.space_counts:
            even = pc.and_(even, pc.invert(pc.match_substring_regex(texts, _UNEVEN)))
        parted = texts
        for mark in ".,":
            for space in " \n":
                parted = pc.replace_substring(parted, mark + space, f" {_EXACT}{mark}{space}")
        if self.space_counts:
            # What begins or ends with white space is cut run by run; so is an empty text, into nothing.
            even = pc.and_(even, pc.match_substring_regex(parted, r"(?s)^[^ \n](.*[^ ])?$"))
        even = even.to_numpy(zero_copy_only=False)
        own = parted.filter(pa.array(even))
        if self.space_counts:
            own = pc.binary_join_element_wise(
                pa.scalar(_EXACT, own.type), pc.replace_substring(own, "\n", " \n"), pa.scalar("", own.type))
            lists = pc.split_pattern(own, " ")
        else:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(own) if self.lower_case else own)
        counts, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        if not self.space_counts:
            full = pc.greater(pc.binary_length(flat), 0)
            kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
            ends = np.cumsum(counts)
            counts, flat = kept[ends] - kept[ends - counts], flat.filter(full)
        return flat, counts, even

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts without nulls, and how many belong to each text."""
        with without_cycle_search():
            flat, per_even, even = self.cut(texts)
            counts = np.zeros(len(texts), np.int64)
            counts[even] = per_even
            others = np.flatnonzero(~even)
            if len(others):
                rest = [self.cut_rest(t) for t in texts.take(pa.array(others)).to_pylist()]
                counts[others] = np.fromiter(map(len, rest), np.int64, len(rest))
                flat = pa.concat_arrays([flat, pa.array([p for own in rest for p in own], flat.type)])
            numbered = flat.dictionary_encode()
            code = self.memo.numbers(numbered.dictionary)[numbered.indices.to_numpy(zero_copy_only=False)]
            if len(others):
                of = np.concatenate([np.repeat(np.flatnonzero(even), per_even), np.repeat(others, counts[others])])
                code = code[np.argsort(of, kind="stable")]
            return self.memo.put_together(code, counts)

    def cut_rest(self, text: str) -> list[str]:
        if not text:
            return []
        if _ODD_TEXT.search(text):
            return [_EXACT + text]
        return pieces_of_runs(text) if self.space_counts else [_EXACT + w for w in text.split()]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many belong to each text."""
        return self.encode(pa.array(texts, pa.large_string()))


_ODD_TEXT = re.compile(_ODD)


@lru_cache(maxsize=2)
def library_tokens(path: str, space_counts: bool, lower_case: bool = False) -> LibraryTokens:
    """One per worker process."""
    return LibraryTokens(path, space_counts, lower_case)
