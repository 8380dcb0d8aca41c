"""Quality by attention-based multiple-instance learning: a document is a bag of passages with one label.

Every PASSAGE_WORDS words of a text are a passage. A passage's input is its profile of byte pairs (bytes in
classes: letters, digits, single marks, parts of other characters) and a few shares: repeated words, repeated word
pairs, capitals and so on. A dense layer encodes each passage; gated attention, tanh(V h) * sigmoid(U h) weighted by w, gives every passage its share
of the document, and the weighted sum of the encoded passages is scored. Labels are those of documents only;
encoder, gates and scorer are trained together, by numpy, on a bounded sample of labelled documents.

Texts are read as the bytes of the Arrow column, all words of a batch at once. A text of more than PIECE_BYTES is cut
after white space into pieces whose passages are pooled together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from slotwise.llm.common import give_back_memory, labelled_sample, without

PASSAGE_WORDS = 100
#: Bytes and texts that are described at a time; a longer text is cut into pieces of at most so many bytes.
PIECE_BYTES, PIECE_TEXTS = 1 << 19, 1_024
#: Width of the encoded passage and of its gates.
HIDDEN, GATES = 24, 16
#: Most training documents of each label, and most characters of each.
TRAINING_DOCS, TRAINING_CHARS = 1_500, 12_000
#: Passages per matrix product.
CHUNK = 4_096

# Classes of bytes: white space and line ends, letters one by one without case, digits, marks one by one, then
# continuation bytes, lead bytes and control characters.
_SPACES = b" \t\n\r\f\v"
_KIND = np.zeros(256, np.uint8)
_KIND[list(range(128, 192))], _KIND[list(range(192, 256))] = 61, 62
_KIND[list(range(33))] = 63
_KIND[list(_SPACES)] = 0
_KIND[ord("\n")] = 1
for _i in range(26):
    _KIND[ord("a") + _i] = _KIND[ord("A") + _i] = 2 + _i
_KIND[list(b"0123456789")] = 28
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 29 + _i
KINDS = 64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True

SHARES = ("one", "short", "word_length", "capitals", "letters", "distinct", "repeated_pairs", "echoes", "line_ends")
INPUTS = KINDS * KINDS + len(SHARES)


def cut(data: bytes | np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """A long range of bytes in pieces that end after white space, or at PIECE_BYTES where there is none."""
    pieces = []
    while end - start > PIECE_BYTES:
        spaces = np.flatnonzero(_IS_SPACE[data[start:start + PIECE_BYTES]])
        stop = start + (int(spaces[-1]) + 1 if len(spaces) else PIECE_BYTES)
        pieces.append((start, stop))
        start = stop
    pieces.append((start, end))
    return pieces


def _repeats(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Per group the share of values that occurred in it before."""
    mixed = value * np.uint64(0x9E3779B97F4A7C15) ^ (group.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(value), bool)
    again[order[1:]] = (mixed[order[1:]] == mixed[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    return np.bincount(group, again, groups) / np.maximum(1, np.bincount(group, minlength=groups))


def describe(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of texts laid end to end (each ends where `ends` says): text of each passage, and inputs.

    A passage is PASSAGE_WORDS words, the last one of a text has what is left. A text without words has none.
    """
    space = _IS_SPACE[data]
    begins = np.concatenate([[0], ends[:-1]])
    first = ~space
    first[1:] &= space[:-1]
    inside = begins[begins < ends]
    first[inside] |= ~space[inside]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, INPUTS), np.float32)
    text = np.searchsorted(ends, at, side="right")
    number = np.arange(len(at)) - np.searchsorted(text, text)
    opens = number % PASSAGE_WORDS == 0
    passage = np.cumsum(opens) - 1
    n = int(passage[-1]) + 1
    of_text = text[opens]
    # Bytes before a text's first word belong to no passage; those after a word to the word's.
    word = np.cumsum(first) - 1
    owner = np.searchsorted(ends, np.arange(len(data)), side="right") if len(ends) > 1 else np.zeros(len(data), np.int64)
    valid = (word >= 0) & (text[np.maximum(word, 0)] == owner)
    own = passage[np.maximum(word, 0)]
    kind = _KIND[data].astype(np.int64)
    pair_ok = valid[:-1] & valid[1:] & (own[:-1] == own[1:])
    pairs = np.bincount(own[:-1][pair_ok] * (KINDS * KINDS) + (kind[:-1] * KINDS + kind[1:])[pair_ok],
                        minlength=n * KINDS * KINDS).reshape(n, -1)
    inputs = np.empty((n, INPUTS), np.float32)
    total = np.maximum(1, pairs.sum(1, keepdims=True))
    inputs[:, :KINDS * KINDS] = np.sqrt(pairs / total)
    letters = valid & ~space

    def per_passage(which: np.ndarray) -> np.ndarray:
        return np.bincount(own[which], minlength=n)

    words = np.bincount(passage, minlength=n)
    chars, upper, alphas = per_passage(letters), per_passage(letters & _IS_UPPER[data]), per_passage(
        letters & (((kind >= 2) & (kind < 28)) | (kind > 60)))
    # A word's hash sums its bytes by place, without case.
    place = np.arange(len(data)) - at[np.maximum(word, 0)]
    mixed = (kind + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed[space] = 0
    hashes = np.add.reduceat(mixed, at)
    next_to = passage[1:] == passage[:-1]
    both = hashes[:-1] * np.uint64(0x94D049BB133111EB) + hashes[1:]
    inputs[:, KINDS * KINDS:] = np.stack([
        np.ones(n), words < 10, np.minimum(1, chars / words / 20), upper / np.maximum(1, alphas), alphas / np.maximum(1, chars),
        1 - _repeats(passage, hashes, n), _repeats(passage[:-1][next_to], both[next_to], n),
        np.bincount(passage[1:][next_to], (hashes[1:] == hashes[:-1])[next_to], n) / words,
        np.minimum(1, per_passage(valid & (data == 10)) / words)], axis=1)
    return of_text, inputs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """Weights by name: encode, encode_bias, look, gate, pick, out, bias."""

    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, seed: int = 23) -> Attention:
        rnd = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rnd.normal(size=shape) * scale).astype(np.float32)

        return cls({"encode": draw(INPUTS, HIDDEN, scale=0.3), "encode_bias": np.zeros(HIDDEN, np.float32),
                    "look": draw(HIDDEN, GATES, scale=HIDDEN**-0.5), "gate": draw(HIDDEN, GATES, scale=HIDDEN**-0.5),
                    "pick": draw(GATES, scale=GATES**-0.5), "out": draw(HIDDEN, scale=HIDDEN**-0.5),
                    "bias": np.zeros(1, np.float32)})

    def encode(self, inputs: np.ndarray) -> np.ndarray:
        return np.tanh(inputs @ self.weights["encode"] + self.weights["encode_bias"])

    def attend(self, encoded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention logit of each passage, with its look and its gate."""
        look, gate = np.tanh(encoded @ self.weights["look"]), _sigmoid(encoded @ self.weights["gate"])
        return (look * gate) @ self.weights["pick"], look, gate

    def pool(self, encoded: np.ndarray, logits: np.ndarray, starts: np.ndarray, of: np.ndarray):
        """Weighted passage representation per document, and the passages' shares; passages lie by document."""
        share = np.exp(logits - np.maximum.reduceat(logits, starts)[of])
        share /= np.add.reduceat(share, starts)[of]
        return np.add.reduceat(share[:, None] * encoded, starts, axis=0), share

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return _sigmoid(pooled @ self.weights["out"] + self.weights["bias"])

    def gradient(self, inputs: np.ndarray, starts: np.ndarray, of: np.ndarray, labels: np.ndarray, weight: np.ndarray):
        """Of the weighted log loss of documents."""
        w = self.weights
        encoded = self.encode(inputs)
        logits, look, gate = self.attend(encoded)
        pooled, share = self.pool(encoded, logits, starts, of)
        error = ((self.score(pooled) - labels) * weight).astype(np.float32)
        d_pooled = error[:, None] * w["out"]
        d_share = np.einsum("ph,ph->p", d_pooled[of], encoded)
        d_logit = share * (d_share - np.add.reduceat(share * d_share, starts)[of])
        d_look = d_logit[:, None] * w["pick"] * gate * (1 - look**2)
        d_gate = d_logit[:, None] * w["pick"] * look * gate * (1 - gate)
        d_encoded = share[:, None] * d_pooled[of] + d_look @ w["look"].T + d_gate @ w["gate"].T
        d_inner = d_encoded * (1 - encoded**2)
        return {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32), "pick": (look * gate).T @ d_logit,
                "look": encoded.T @ d_look, "gate": encoded.T @ d_gate, "encode": inputs.T @ d_inner,
                "encode_bias": d_inner.sum(0)}


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def train(examples: list[tuple[str, int]], rounds: int = 24, batch: int = 128, speed: float = 0.01, shrink: float = 1e-4,
          seed: int = 7) -> Attention:
    """Fit by Adam on documents; both labels weigh the same. Without examples of both every text with words is good."""
    net = Attention.start()
    parts, labels = [], []
    for text, label in examples:
        _, inputs = describe(*_laid_out([text.encode()]))
        if len(inputs):
            parts.append(inputs.astype(np.float16))  # half the memory while the sample waits
            labels.append(label)
    if len(set(labels)) < 2:
        net.weights["out"][:] = 0
        net.weights["bias"][:] = 4
        return net
    labels = np.array(labels, np.float32)
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rnd = np.random.default_rng(seed)
    means, squares, turn = {k: 0.0 for k in net.weights}, {k: 0.0 for k in net.weights}, 0
    for _ in range(rounds):
        order = rnd.permutation(len(parts))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            inputs = np.concatenate([parts[p] for p in pick]).astype(np.float32)
            sizes = np.array([len(parts[p]) for p in pick])
            starts = np.cumsum(sizes) - sizes
            grads = net.gradient(inputs, starts, np.repeat(np.arange(len(pick)), sizes), labels[pick], share[pick] / len(pick))
            turn += 1
            for name, grad in grads.items():
                grad = grad + shrink * net.weights[name]
                means[name] = 0.9 * means[name] + 0.1 * grad
                squares[name] = 0.999 * squares[name] + 0.001 * grad**2
                net.weights[name] -= speed * (means[name] / (1 - 0.9**turn)) / (
                    np.sqrt(squares[name] / (1 - 0.999**turn)) + 1e-8)
    return net


def score_batch(net: Attention, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of the texts data[offsets[i]:offsets[i + 1]]; a text without words has 0."""
    rows, encoded, logits = [], [], []
    held: list[tuple[int, int, int]] = []

    def flush() -> None:
        pieces = np.concatenate([data[a:b] for _, a, b in held])
        at, inputs = describe(pieces, np.cumsum([b - a for _, a, b in held]))
        row = np.array([r for r, _, _ in held])[at]
        for i in range(0, len(row), CHUNK):
            own = net.encode(inputs[i:i + CHUNK])
            rows.append(row[i:i + CHUNK])
            encoded.append(own)
            logits.append(net.attend(own)[0])
        held.clear()

    size = 0
    for r, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for a, b in cut(data, start, end):
            if held and (size + b - a > PIECE_BYTES or len(held) == PIECE_TEXTS):
                flush()
                size = 0
            held.append((r, a, b))
            size += b - a
    if held:
        flush()
    out = np.zeros(len(offsets) - 1)
    of_row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    if len(of_row):
        present, of = np.unique(of_row, return_inverse=True)
        starts = np.searchsorted(of_row, present)
        pooled, _ = net.pool(np.concatenate(encoded), np.concatenate(logits), starts, of)
        out[present] = net.score(pooled)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Attention:
    """Train on a bounded sample of labelled documents; `labels` has the rows that may be learned from."""
    return train(labelled_sample(docs, labels, "quality", TRAINING_DOCS, TRAINING_DOCS, TRAINING_CHARS))


def score(docs: DataFrame, net: Attention, name: str = "quality_score") -> DataFrame:
    """The rows of `docs`, all columns kept, with a score from 0 to 1 in the column `name`.

    Whole texts, every passage; only the text is an input. Null, empty and wordless texts have 0; repeated rows
    and null ids are scored like any other; an empty table gives no rows. A column that has the name already is
    replaced. No shuffle; the network's size is fixed.
    """
    docs = without(docs, [name])
    weights = docs.sparkSession.sparkContext.broadcast(net.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Attention(weights.value)
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.large_string())
            _, places, content = texts.buffers()
            offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
            found = score_batch(own, data, offsets) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])
        give_back_memory()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
