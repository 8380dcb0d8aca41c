"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is a vector of the word itself plus the mean vector of its character n-grams, both from hashed
tables, so unknown words are known by their letters. A longer run of word characters than LONGEST (text without
spaces, words joined by underscores) is read as pieces of PIECE characters, each overlapping half of the one
before, which are words of their own. Windows of WINDOW words, each overlapping half of the
one before, run through a GRU in both directions; attention pools the states of a window to one
probability, and the highest window is the document's score. Training (numpy) sees document labels only:
first every window has its document's label, then in each document the windows that score highest count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from slotwise.llm.common import labelled_sample, text_slices, without

WINDOW, STRIDE = 32, 16
#: Most characters of a word, and those of each piece of a longer run: near a word's, so that its n-grams are not averaged away.
LONGEST, PIECE = 64, 32
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 1 << 15, 1 << 14, 16, 12
#: Most training documents with label 0 and 1, and most characters of each.
TRAINING_CLEAN, TRAINING_TOXIC, TRAINING_CHARS = 2_000, 1_200, 4_000
#: Words that a worker remembers with their inputs; beyond it (but for the batch at hand) the later half goes.
MEMO_WORDS = 200_000
#: Windows per matrix product.
CHUNK = 2_048

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Runs of word characters in lower case, long ones in overlapping pieces; the last piece ends with the run."""
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    step = PIECE // 2
    return [piece for w in words for piece in (
        [w] if len(w) <= LONGEST else [w[i:i + PIECE] for i in range(0, len(w) - step, step)])]


@dataclass
class WordRows:
    """Table rows of words: one of the word table each, and `counts` of the n-gram table, word after word."""

    own: np.ndarray
    grams: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> WordRows:
        """n-grams of 3 to 5 bytes of the word with its edges marked, numbered by a rolling hash.

        Of words as words_of makes them; of a longer one only the first LONGEST characters have n-grams.
        """
        digest = xxhash.xxh32_intdigest
        own = np.fromiter((digest(w) % WORD_ROWS for w in words), np.int64, len(words))
        marked = [b"<%s>" % w[:LONGEST].encode() for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        letters = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.cumsum(sizes)[word] - np.arange(len(letters))  # bytes up to the word's end
        rows, of_word = [], []
        number = letters
        for n in range(2, 6):
            number = number[:-1] * np.uint64(0x9E3779B1) + letters[n - 1:] if len(number) else number
            if n > 2 and len(number):
                at = np.flatnonzero(left[:len(number)] >= n)
                rows.append(((number[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % GRAM_ROWS)
                of_word.append(word[at])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.concatenate(of_word) if rows else np.zeros(0, np.int64)
        return cls(own, flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words)))

    def pick(self, at: np.ndarray) -> WordRows:
        counts = self.counts[at]
        starts, ends = (np.cumsum(self.counts) - self.counts)[at], np.cumsum(counts)
        flat = np.arange(int(counts.sum())) + np.repeat(starts - (ends - counts), counts)
        return WordRows(self.own[at], self.grams[flat], counts)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over documents with so many words, laid end to end: document, first word, words inside.

    The last window of a document ends with it; a document without words has no window.
    """
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    document = np.repeat(np.arange(len(counts)), per)
    turn = np.arange(len(document)) - np.repeat(np.cumsum(per) - per, per)
    first = np.minimum(turn * STRIDE, np.maximum(0, counts[document] - WINDOW))
    base = (np.cumsum(counts) - counts)[document]
    return document, base + first, np.minimum(WINDOW, counts[document])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights by name; `ahead` and `back` are the two directions."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 11) -> Network:
        rnd = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rnd.normal(size=shape) * scale).astype(np.float32)

        w = {"words": draw(WORD_ROWS, WIDTH, scale=0.1), "grams": draw(GRAM_ROWS, WIDTH, scale=0.1)}
        for side in ("ahead", "back"):
            w[f"{side}_in"] = draw(WIDTH, 3 * HIDDEN, scale=WIDTH**-0.5)
            w[f"{side}_own"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            w[f"{side}_bias"] = np.zeros(3 * HIDDEN, np.float32)
        w |= {"look": draw(2 * HIDDEN, HIDDEN, scale=(2 * HIDDEN)**-0.5), "pick": draw(HIDDEN, scale=HIDDEN**-0.5),
              "out": draw(2 * HIDDEN, scale=(2 * HIDDEN)**-0.5), "bias": np.full(1, -1, np.float32)}
        return cls(w)

    def word_vectors(self, rows: WordRows) -> np.ndarray:
        """Vector of each word: its own row and the sum of its n-grams' rows over the root of their number."""
        if not len(rows.own):
            return np.zeros((0, WIDTH), np.float32)
        total = np.add.reduceat(self.weights["grams"][rows.grams], np.cumsum(rows.counts) - rows.counts, axis=0)
        return self.weights["words"][rows.own] + total / np.sqrt(rows.counts)[:, None].astype(np.float32)

    def run_side(self, side: str, gates: np.ndarray, place: np.ndarray, inside: np.ndarray, keep: list | None):
        """States of one direction, (WINDOW, windows, HIDDEN). gates: inputs per word; place: rows of it per window."""
        own = self.weights[f"{side}_own"]
        state = np.zeros((len(place), HIDDEN), np.float32)
        states = np.empty((WINDOW, len(place), HIDDEN), np.float32)
        whole = bool(inside.all())
        for t in range(WINDOW) if side == "ahead" else range(WINDOW - 1, -1, -1):
            g, h = gates[place[:, t]], state @ own
            zr = _sigmoid(g[:, :2 * HIDDEN] + h[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN:] + r * h[:, 2 * HIDDEN:])
            after = new + z * (state - new)
            if not whole:
                after = np.where(inside[:, t, None], after, state)
            if keep is not None:
                keep.append((t, state, z, r, new, h[:, 2 * HIDDEN:]))
            state = states[t] = after
        return states

    def pool(self, states: np.ndarray, inside: np.ndarray):
        """Attention over a window: logits, weights (WINDOW, windows), pooled states, looks."""
        w = self.weights
        looks = np.tanh(states @ w["look"])
        score = np.where(inside.T, looks @ w["pick"], -np.inf)
        score = np.exp(score - score.max(0))
        share = score / score.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ w["out"] + w["bias"], share, pooled, looks

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """Inputs of both directions per word."""
        w = self.weights
        return np.concatenate([vectors @ w["ahead_in"] + w["ahead_bias"], vectors @ w["back_in"] + w["back_bias"]], axis=1)

    def gates_of(self, rows: WordRows) -> np.ndarray:
        """Gate inputs of words, some at a time."""
        out = np.empty((len(rows.own), 6 * HIDDEN), np.float32)
        for i in range(0, len(out), CHUNK):
            out[i:i + CHUNK] = self.gates(self.word_vectors(rows.pick(np.arange(i, min(i + CHUNK, len(out))))))
        return out

    def logits(self, gates: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Logit per window: `row` has the gates' row of each word, a window `count` words from `first` on."""
        ahead, back = np.ascontiguousarray(gates[:, :3 * HIDDEN]), np.ascontiguousarray(gates[:, 3 * HIDDEN:])
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), CHUNK):
            place, inside = _places(row, first[i:i + CHUNK], count[i:i + CHUNK])
            states = np.concatenate([self.run_side("ahead", ahead, place, inside, None),
                                     self.run_side("back", back, place, inside, None)], axis=2)
            out[i:i + CHUNK] = self.pool(states, inside)[0]
        return out

    def gradient(self, vectors: np.ndarray, place: np.ndarray, inside: np.ndarray, label: np.ndarray,
                 weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted log loss of windows: per weight, and per word vector."""
        w, n = self.weights, len(place)
        gates = self.gates(vectors)
        kept: dict[str, list] = {"ahead": [], "back": []}
        side_gates = {"ahead": gates[:, :3 * HIDDEN], "back": gates[:, 3 * HIDDEN:]}
        states = np.concatenate(
            [self.run_side(s, side_gates[s], place, inside, kept[s]) for s in ("ahead", "back")], axis=2)
        logit, share, pooled, looks = self.pool(states, inside)
        d_logit = ((_sigmoid(logit) - label) * weight).astype(np.float32)
        grads = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * w["out"]
        d_share = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = share * (d_share - (share * d_share).sum(0))
        grads["pick"] = np.einsum("tn,tnh->h", d_score, looks)
        d_look = d_score[..., None] * w["pick"] * (1 - looks**2)
        grads["look"] = np.einsum("tnh,tnk->hk", states, d_look, optimize=True)
        d_states = share[..., None] * d_pooled + d_look @ w["look"].T
        d_vectors = np.zeros_like(vectors)
        for s, part in (("ahead", slice(0, HIDDEN)), ("back", slice(HIDDEN, None))):
            own, into = w[f"{s}_own"], w[f"{s}_in"]
            d_own, d_gates = np.zeros_like(own), np.zeros((len(vectors), 3 * HIDDEN), np.float32)
            steps, places = [], []
            carry = np.zeros((n, HIDDEN), np.float32)
            for t, state, z, r, new, h_new in reversed(kept[s]):
                d = carry + d_states[t, :, part]
                here = inside[:, t, None]
                d_in = np.where(here, d, 0)
                d_new = d_in * (1 - z) * (1 - new**2)
                d_z = d_in * (state - new) * z * (1 - z)
                d_r = d_new * h_new * r * (1 - r)
                d_h = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_own += state.T @ d_h
                carry = np.where(here, d * z, d) + d_h @ own.T
                steps.append(np.concatenate([d_z, d_r, d_new], axis=1))
                places.append(place[:, t])
            total, at = _sum_rows(np.concatenate(places), np.concatenate(steps))
            d_gates[at] = total
            grads |= {f"{s}_own": d_own, f"{s}_in": vectors.T @ d_gates, f"{s}_bias": d_gates.sum(0)}
            d_vectors += d_gates @ into.T
        return grads, d_vectors


def _places(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of each window, and which of them are inside."""
    step = np.arange(WINDOW)
    inside = step < count[:, None]
    return row[np.where(inside, first[:, None] + step, first[:, None])], inside


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the values of each distinct row, and these rows."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    return np.add.reduceat(values[order], starts, axis=0), sorted_rows[starts]


def train(examples: list[tuple[str, int]], updates: int = 80, late_updates: int = 50, batch: int = 256,
          speed: float = 0.1, seed: int = 5) -> Network:
    """Fit by Adagrad. First a window has its document's label; later only the highest window of each toxic
    document and the two highest of each clean one are learned from. Both parts run whole rounds, at least two
    and three, until they have made so many updates, so that small samples are learned as well."""
    net = Network.start()
    texts = [(words, label) for text, label in examples if (words := words_of(text))]
    if len({label for _, label in texts}) < 2:
        net.weights["bias"][:] = -4  # nothing to learn from: every text is clean
        net.weights["out"][:] = 0
        return net
    numbers: dict[str, int] = {}
    row = np.array([numbers.setdefault(w, len(numbers)) for words, _ in texts for w in words])
    tables = WordRows.of(list(numbers))
    counts = np.array([len(words) for words, _ in texts])
    labels = np.array([label for _, label in texts], np.float32)
    document, first, inside_count = windows_of(counts)
    rnd = np.random.default_rng(seed)
    sums = {k: np.full_like(v, 1e-6) for k, v in net.weights.items()}

    def update(name: str, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        sums[name][at] += grad**2
        net.weights[name][at] -= speed * grad / np.sqrt(sums[name][at])

    early = max(2, -(-updates * batch // len(document)))
    late = max(3, -(-late_updates * batch // int((2 - labels).sum())))
    for turn in range(early + late):
        if turn < early:
            chosen = np.arange(len(document))
            # Long documents say less per window.
            share = 1 / np.sqrt(np.bincount(document, minlength=len(counts)))[document]
        else:
            logit = net.logits(net.gates_of(tables), row, first, inside_count)
            order = np.lexsort((-logit, document))
            rank = np.arange(len(order)) - np.searchsorted(document[order], document[order])
            chosen = order[(rank == 0) | ((rank == 1) & (labels[document[order]] == 0))]
            share = np.ones(len(document))
        rnd.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            pick = chosen[i:i + batch]
            place, inside = _places(row, first[pick], inside_count[pick])
            used, place = np.unique(place, return_inverse=True)
            place = place.reshape(len(pick), WINDOW)
            own = tables.pick(used)
            vectors = net.word_vectors(own)
            weight = share[pick] / len(pick)
            grads, d_vectors = net.gradient(vectors, place, inside, labels[document[pick]], weight)
            for name, grad in grads.items():
                update(name, grad)
            update("words", *_sum_rows(own.own, d_vectors))
            each = np.repeat(d_vectors / np.sqrt(own.counts)[:, None].astype(np.float32), own.counts, axis=0)
            update("grams", *_sum_rows(own.grams, each))
    return net


class Scorer:
    """A network with the gate inputs of the words met so far."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.gates = np.zeros((1 << 14, 6 * HIDDEN), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list(dict.fromkeys(w for w in words if w not in known))
        if len(known) + len(new) > MEMO_WORDS:
            known = self.known = dict(islice(known.items(), MEMO_WORDS // 2))
            new = list(dict.fromkeys(w for w in words if w not in known))
        if new:
            start = len(known)
            if (need := start + len(new)) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((need, 6 * HIDDEN), np.float32)])
            for i in range(0, len(new), CHUNK):
                part = new[i:i + CHUNK]
                self.gates[start + i:start + i + len(part)] = self.net.gates(self.net.word_vectors(WordRows.of(part)))
            known.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability per text; a text without words has 0."""
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        row = self.rows(list(chain.from_iterable(words)))
        document, first, inside = windows_of(counts)
        out = np.full(len(texts), -np.inf)
        if len(document):
            np.maximum.at(out, document, self.net.logits(self.gates, row, first, inside))
        return np.where(counts > 0, _sigmoid(out), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on a bounded sample of labelled documents; `labels` has the rows that may be learned from."""
    return train(labelled_sample(docs, labels, "toxic", TRAINING_CLEAN, TRAINING_TOXIC, TRAINING_CHARS))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs`, all columns kept, with `t_score` from 0 to 1.

    Whole texts, every window, long runs of word characters in pieces. Null, empty and wordless texts have 0; repeated rows and null ids are
    scored like any other. Only the text is an input. A column t_score that is there already is replaced; an empty table
    gives no rows. No shuffle; the network's size is fixed.
    """
    docs = without(docs, ["t_score"])
    weights = docs.sparkSession.sparkContext.broadcast(net.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(weights.value))
        for batch, texts in text_slices(batches):
            found = scorer.scores([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "t_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("t_score", DoubleType())]))
