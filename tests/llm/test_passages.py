"""Passage attention: bags against plain Python, gradients, planted passages, held-out labels."""

import re
import zlib

import numpy as np
import pytest

from slotwise.llm import passages
from slotwise.llm.defaults import GOOD_FROM
from slotwise.llm.queries import LLM_QUERIES

WORD = re.compile(rb"[^ \t\n\r\f\v]+")


def _laid_out(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data])


def test_passages_cover_every_word():
    texts = ["", "one", " ", "a b\n" * 130, "x" * 300, "あ é " * 101, "end"]
    of, inputs = passages.describe(*_laid_out(texts))
    want = [i for i, t in enumerate(texts) for _ in range(-(-len(WORD.findall(t.encode())) // passages.PASSAGE_WORDS))]
    assert of.tolist() == want and inputs.shape == (len(want), passages.INPUTS)
    profile = inputs[:, :passages.KINDS**2]
    full = (profile**2).sum(1)
    assert np.allclose(full, 1, atol=1e-4)


def test_texts_do_not_touch():
    texts = ["good words here", "BAD!! BAD!! " * 120, "12 34 56"]
    together = passages.describe(*_laid_out(texts))[1]
    alone = np.concatenate([passages.describe(*_laid_out([t]))[1] for t in texts])
    assert np.allclose(together, alone)


def test_long_texts_are_cut_after_white_space():
    data = np.frombuffer(("word " * 300_000 + "x" * 2_000_000).encode(), np.uint8)
    pieces = passages.cut(data, 0, len(data))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    assert all(a[1] == b[0] and a[1] - a[0] <= passages.PIECE_BYTES for a, b in zip(pieces, pieces[1:]))
    assert data[pieces[0][1] - 1] == 32


def test_gradient_is_the_loss_slope():
    rnd = np.random.default_rng(1)
    net = passages.Attention.start()
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    inputs = np.abs(rnd.normal(size=(7, passages.INPUTS))) * 0.1
    starts, of = np.array([0, 2, 3]), np.array([0, 0, 1, 2, 2, 2, 2])
    labels, weight = np.array([1.0, 0, 1]), np.array([0.2, 0.5, 0.3])

    def loss():
        encoded = net.encode(inputs)
        p = net.score(net.pool(encoded, net.attend(encoded)[0], starts, of)[0])
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    grads = net.gradient(inputs, starts, of, labels, weight)
    for name, grad in grads.items():
        at = tuple(rnd.integers(0, n) for n in np.shape(grad))
        net.weights[name][at] += 1e-5
        up = loss()
        net.weights[name][at] -= 2e-5
        slope = (up - loss()) / 2e-5
        net.weights[name][at] += 1e-5
        assert np.isclose(slope, grad[at], rtol=1e-3, atol=1e-6), name


@pytest.fixture(scope="module")
def net():
    rnd = np.random.default_rng(2)
    words = ["the", "river", "a", "of", "walked", "slowly", "house", "and", "green"]

    def prose(n):
        return " ".join(rnd.choice(words, n)) + "."

    good = [(prose(n), 1) for n in rnd.integers(20, 500, 150)]
    bad = [(re.sub(" ", "### ", prose(n)), 0) for n in rnd.integers(20, 500, 60)] + [("MENU | LOGIN | " * n, 0) for n in rnd.integers(3, 90, 60)]
    return passages.train(good + bad, rounds=12)


def _scores(net, texts):
    data, ends = _laid_out(texts)
    return passages.score_batch(net, data, np.concatenate([[0], ends]))


def test_attention_finds_the_telling_passage(net):
    bad, good = "MENU | LOGIN | " * 60, "the river walked slowly and of a green house " * 60
    inputs = passages.describe(*_laid_out([good + bad]))[1]
    encoded = net.encode(inputs)
    logits, _, _ = net.attend(encoded)
    pooled, share = net.pool(encoded, logits, np.array([0]), np.zeros(len(inputs), np.int64))
    assert np.isclose(share.sum(), 1) and share.max() > share.min()
    low, high, mixed = _scores(net, [bad, good, good + bad])
    assert low < GOOD_FROM < high and low <= mixed <= high


def test_pieces_and_batches_do_not_change_scores(net, monkeypatch):
    texts = ["the river " * 4000, "", "MENU | LOGIN | " * 3000, " \n", "house of green"] * 3
    whole = _scores(net, texts)
    assert (whole[[1, 3]] == 0).all()
    monkeypatch.setattr(passages, "PIECE_TEXTS", 2)
    assert np.allclose(_scores(net, texts), whole, atol=1e-6)
    assert np.allclose([_scores(net, [t])[0] for t in texts], whole, atol=1e-6)
    monkeypatch.setattr(passages, "PIECE_BYTES", 1000 * len("the river "))
    assert np.allclose(_scores(net, texts[:1]), whole[:1], atol=1e-6)


def test_awkward_rows(spark, edge_docs, no_docs, net):
    rows = passages.score(edge_docs, net).collect()
    assert len(rows) == edge_docs.count() and rows[0].__fields__[:len(edge_docs.columns)] == edge_docs.columns
    assert all(0 <= r.quality_score <= 1 for r in rows)
    assert {r.quality_score for r in rows if not (r.text or "").strip(" \t\n\r\f\v")} == {0.0}
    assert passages.score(no_docs, net).count() == 0
    again = passages.score(edge_docs.withColumn("Quality_Score", edge_docs["doc_id"]), net)
    assert again.columns == [*edge_docs.columns, "quality_score"]


def test_without_both_labels_every_text_is_good(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert min(_scores(passages.fit(docs, labels), ["some text"])) > 0.9


def test_op11_on_held_out_labels(spark, sf_dir):
    rows = LLM_QUERIES["op11_passage_attention"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= GOOD_FROM) for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    bad, good = [p for p, q in held if q == 0], [p for p, q in held if q == 1]
    assert len(bad) > 5 and len(good) > 30
    assert 1 - np.mean(bad) >= 0.9 and np.mean(good) >= 0.95
