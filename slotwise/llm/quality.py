"""Quality rules: Viterbi decoding of a linear-chain CRF marks lines as content or boilerplate.

The share of a document's word characters in content lines decides whether it stays. The conditional random
field is trained here, by numpy, on a bounded sample of documents with a quality label. A line's own label is not
known: it starts as its document's and is estimated anew between rounds of training by forward and backward sums,
under the constraint that most lines of a good document are content and most of a bad one are not. Documents
are of one kind from end to end, so moves between the kinds are learned from mixtures: lines of bad documents
planted in good ones and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from slotwise.llm.common import labelled_sample, text_slices, without

#: Most labelled documents of each label that the field is trained on.
TRAINING_DOCS = 1_000
#: Labelled documents with more characters are not drawn for training.
TRAINING_CHARS = 8_000
#: A document stays if at least this share of its word characters is in content lines.
CONTENT_SHARE = 0.5
#: Percent of words that may lie in repeated windows, and the fewest words of a document that stays.
MOST_REPEATED, LEAST_WORDS = 20, 10

# Byte classes of UTF-8 text.
_SPACE, _SYMBOL, _UPPER, _DIGIT, _MARK, _BAR, _TAIL, _LETTER = (1 << i for i in range(8))
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in ((b" \t\n\r\f\v", _SPACE), (b"#*$%&|<>", _SYMBOL), (bytes(range(65, 91)), _UPPER),
                     (b"0123456789", _DIGIT), (b"!?@=_~^{}[]\\/+", _MARK), (b"|", _BAR),
                     (bytes(range(128, 192)), _TAIL),
                     (bytes([*range(65, 91), *range(97, 123), *range(192, 256)]), _LETTER)):
    _CLASS[list(_chars)] |= _bit

FEATURES = ("one", "no_words", "few_words", "symbols", "bars", "marks", "digits", "upper", "long_words",
            "repeats", "earlier_line", "ends_sentence")


@dataclass(frozen=True)
class LineField:
    """A linear-chain CRF over two labels, 0 boilerplate and 1 content."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # from x to

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most likely labels of one document's lines; of two equal paths the one with more content."""
        scores = features @ self.emit
        best, back = scores[0], np.zeros((len(scores), 2), np.int64)
        for i in range(1, len(scores)):
            paths = best[:, None] + self.move
            back[i] = np.where(paths[1] >= paths[0], 1, 0)
            best = np.maximum(paths[0], paths[1]) + scores[i]
        labels = np.empty(len(scores), np.int64)
        labels[-1] = int(best[1] >= best[0])
        for i in range(len(scores) - 1, 0, -1):
            labels[i - 1] = back[i, labels[i]]
        return labels

    def gradient(self, features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of one document's labels, by forward and backward sums."""
        n, scores = len(labels), features @ self.emit
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = scores[0]
        for i in range(1, n):
            ahead[i] = scores[i] + np.logaddexp(ahead[i - 1, 0] + self.move[0], ahead[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            x = scores[i + 1] + behind[i + 1]
            behind[i] = np.logaddexp(self.move[:, 0] + x[0], self.move[:, 1] + x[1])
        total = np.logaddexp(*ahead[-1])
        share = np.exp(ahead + behind - total)
        own = np.eye(2)[labels]
        emit = features.T @ (own - share)
        move = np.zeros((2, 2))
        if n > 1:
            pair = ahead[:-1, :, None] + self.move + (scores[1:] + behind[1:])[:, None, :] - total
            move = own[:-1].T @ own[1:] - np.exp(pair).sum(0)
        return emit, move


@dataclass(frozen=True)
class Sequences:
    """Documents' lines laid end to end: features, document and place of each line."""

    features: np.ndarray
    document: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Sequences:
        sizes = np.array([len(d) for d in documents])
        document = np.repeat(np.arange(len(sizes)), sizes)
        return cls(np.concatenate(documents), document, np.arange(len(document)) - np.repeat(np.cumsum(sizes) - sizes, sizes))

    def sums(self, field: LineField, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each line's labels, and the expected moves weighted by document, of all documents at once."""
        n, longest = int(self.document[-1]) + 1, int(self.place.max()) + 1
        scores, there = np.zeros((longest, n, 2)), np.zeros((longest, n), bool)
        scores[self.place, self.document], there[self.place, self.document] = self.features @ field.emit, True
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for i in range(1, longest):
            step = scores[i] + np.logaddexp(ahead[i - 1, :, :1] + field.move[0], ahead[i - 1, :, 1:] + field.move[1])
            ahead[i] = np.where(there[i, :, None], step, ahead[i - 1])
        for i in range(longest - 2, -1, -1):
            x = scores[i + 1] + behind[i + 1]
            step = np.logaddexp(field.move[:, 0] + x[:, :1], field.move[:, 1] + x[:, 1:])
            behind[i] = np.where(there[i + 1, :, None], step, 0)
        total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
        share = np.exp(ahead + behind - total[:, None])
        moves = np.zeros((2, 2))
        if longest > 1:
            x = scores[1:] + behind[1:]
            for a in (0, 1):
                for b in (0, 1):
                    pair = np.exp(ahead[:-1, :, a] + field.move[a, b] + x[:, :, b] - total)
                    moves[a, b] = (np.where(there[1:], pair, 0) @ weight).sum()
        return share[self.place, self.document], moves

    def fit(self, field: LineField, labels: np.ndarray, weight: np.ndarray, rounds: int, step: float, shrink: float) -> LineField:
        """Gradient ascent of the labels' likelihood from a field on; `weight` is the documents'."""
        own = np.eye(2)[labels]
        per_line = (weight / np.bincount(self.document))[self.document]
        per_document = weight / np.bincount(self.document)
        inside = self.document[1:] == self.document[:-1]
        seen = (own[:-1][inside] * per_line[1:][inside, None]).T @ own[1:][inside]
        emit, move = field.emit, field.move
        speed_e, speed_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
        for _ in range(rounds):
            share, moves = self.sums(LineField(emit, move), per_document)
            grad_e = self.features.T @ ((own - share) * per_line[:, None]) - shrink * emit
            grad_m = seen - moves - shrink * move
            speed_e, speed_m = speed_e + grad_e**2, speed_m + grad_m**2
            emit, move = emit + step * grad_e / np.sqrt(speed_e), move + step * grad_m / np.sqrt(speed_m)
        return LineField(emit, move)


def relabelled(labels: list[np.ndarray], of_document: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Each line's likelier label, as long as more than half of the document's lines keep the document's label."""
    out, start = [], 0
    for own, label in zip(labels, of_document.tolist()):
        other = share[start:start + len(own), 1 - label]
        start += len(own)
        new = np.full(len(own), label)
        most = (len(own) - 1) // 2
        likely = np.argsort(-other, kind="stable")[:most]
        new[likely[other[likely] > 0.5]] = 1 - label
        out.append(new)
    return out


def _mixture(host: np.ndarray, guest: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A document's lines with one to three neighbouring lines of another in them, and which lines are guests."""
    size = int(rnd.integers(1, min(3, len(guest)) + 1))
    first, at = int(rnd.integers(0, len(guest) - size + 1)), int(rnd.integers(0, len(host) + 1))
    guests = np.zeros(len(host) + size, bool)
    guests[at:at + size] = True
    return np.concatenate([host[:at], guest[first:first + size], host[at:]]), guests


def train(examples: list[tuple[np.ndarray, int]], rounds: int = 30, step: float = 0.3, shrink: float = 1e-3,
          estimates: int = 3, seed: int = 13) -> LineField:
    """Fit the field to (line features, label of the document), each document weighing the same.

    Between `estimates` fits the lines get labels of their own. The documents' labels' shares are evened out. Without
    examples of both labels every line is content.
    """
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    of_document = np.array([label for _, label in examples], np.int64)
    if len(set(of_document.tolist())) < 2:
        emit[0, 1] = 1.0
        return LineField(emit, move)
    documents, rnd = [features for features, _ in examples], np.random.default_rng(seed)
    labels = [np.full(len(features), label) for features, label in examples]
    weight = 0.5 / np.bincount(of_document)[of_document]
    field = LineField(emit, move)
    for _ in range(estimates):
        # Guests are lines of the other kind that have kept its label.
        sources = {label: [d[own == label] for d, own, kind in zip(documents, labels, of_document) if kind == label]
                   for label in (0, 1)}
        sources = {label: [d for d in own if len(d)] for label, own in sources.items()}
        mixed, mixed_labels = [], []
        for features, own, label in zip(documents, labels, of_document):
            guest = sources[1 - label][int(rnd.integers(0, len(sources[1 - label])))]
            lines, guests = _mixture(features, guest, rnd)
            mixed_own = np.full(len(lines), 1 - label)
            mixed_own[~guests] = own
            mixed.append(lines)
            mixed_labels.append(mixed_own)
        sequences = Sequences.of(documents + mixed)
        # From the last estimate's field on.
        field = sequences.fit(field, np.concatenate(labels + mixed_labels), np.concatenate([weight, weight]) / 2,
                              rounds, step, shrink)
        share, _ = Sequences.of(documents).sums(field, weight)
        labels = relabelled(labels, of_document, share)
    return field


def _windows_found_twice(words: list[bytes], length: int = 5) -> int:
    """Words in windows of `length` words that occur twice or more."""
    n = len(words) - length + 1
    if n < 2:
        return 0
    # Distinct words get numbers, distinct pairs of them too, and so on: windows compare without collisions.
    numbers: dict[bytes, int] = {}
    row = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    window, scale = row[:n], len(numbers)
    for i in range(1, length):
        window = window * scale + row[i:i + n]
        if i < length - 1:
            window = np.unique(window, return_inverse=True)[1]
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def describe(text: str) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Counts of a text, features per line with a word, and word characters per such line."""
    data = text.encode()
    words = data.split()
    if not words:
        return dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), 0), \
            np.zeros((0, len(FEATURES))), np.zeros(0, np.int64)
    lines = data.split(b"\n")
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    # A line begins after each line end; the last one gets a line end as well.
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    begins = np.cumsum(sizes) - sizes
    padded = np.append(classes, np.uint8(_SPACE))

    def per_line(bit: int) -> np.ndarray:
        return np.add.reduceat((padded & bit) != 0, begins, dtype=np.int64)

    chars = np.add.reduceat((padded & (_SPACE | _TAIL)) == 0, begins, dtype=np.int64)
    in_word = (padded & _SPACE) == 0
    begins_word = in_word & ~np.append(False, in_word[:-1])
    n_words = np.add.reduceat(begins_word, begins, dtype=np.int64)
    seen: set[bytes] = set()
    earlier, repeats, sentence = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    for i, line in enumerate(lines):
        if n_words[i]:
            earlier[i] = line in seen
            seen.add(line)
            own = line.split()
            repeats[i] = sum(map(bytes.__eq__, own, own[1:])) / len(own)
            sentence[i] = own[-1][-1:] in b".!?"
    counts = {
        "n_words": len(words), "word_chars": int(chars.sum()), "n_symbols": int(per_line(_SYMBOL).sum()),
        "n_dup_lines": int(earlier.sum()), "n_repeat_words": _windows_found_twice(words)}
    full = np.flatnonzero(n_words)
    c, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    letters = np.maximum(per_line(_LETTER), 1)
    features = np.stack([
        np.ones(len(lines)), letters < 3, n_words < 3, np.minimum(1, 5 * per_line(_SYMBOL) / c),
        np.minimum(1, 4 * per_line(_BAR) / w), np.minimum(1, 5 * per_line(_MARK) / c),
        np.minimum(1, 2 * per_line(_DIGIT) / c), per_line(_UPPER) / letters > 0.5, np.minimum(1, c / w / 30),
        np.minimum(1, 2 * repeats), earlier, sentence], axis=1)[full]
    return counts, features, chars[full]


def base_failed(counts: dict[str, int]) -> bool:
    n = counts["n_words"]
    return n < LEAST_WORDS or 100 * counts["n_repeat_words"] > MOST_REPEATED * n


def content_share(field: LineField, features: np.ndarray, chars: np.ndarray) -> float:
    """Share of word characters in lines that the field calls content; without words 0."""
    return float(chars @ field.viterbi(features) / chars.sum()) if len(chars) else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> LineField:
    examples = []
    for text, label in labelled_sample(docs, labels, "quality", TRAINING_DOCS, TRAINING_DOCS, TRAINING_CHARS):
        _, features, _ = describe(text)
        if len(features):
            examples.append((features, label))
    return train(examples)


def judge(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of `docs`, all columns kept, with counts and verdict in columns that begin with `q_`.

    q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words (long), q_base_failed (boolean),
    q_content_share (double), q_kept (boolean). A null, empty or blank text has no words, fails and does
    not stay; repeated rows and null ids are judged like any other. Columns that have these names already are
    replaced; an empty table gives no rows. No shuffle.
    """
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = without(docs, [f"q_{c}" for c in (*counted, "base_failed", "content_share", "kept")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = []
            for text in texts:
                counts, features, chars = describe(text or "")
                failed, share = base_failed(counts), content_share(field, features, chars)
                rows.append((*(counts[c] for c in counted), failed, share, not failed and share >= CONTENT_SHARE))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in columns)],
                [*batch.schema.names, *(f"q_{c}" for c in (*counted, "base_failed", "content_share", "kept"))])

    new = [StructField(f"q_{c}", LongType()) for c in counted]
    new += [StructField("q_base_failed", BooleanType()), StructField("q_content_share", DoubleType()),
            StructField("q_kept", BooleanType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new]))
