"""Line labels and base counts against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from slotwise.llm import quality
from slotwise.llm.common import labelled_sample
from slotwise.llm.queries import LLM_QUERIES


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }, n < 10 or 100 * len(covered) > 20 * n


def test_op8(spark, sf_dir, docs):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in LLM_QUERIES["op8_line_field"](spark, sf_dir).collect()}
    right = judged = 0
    for r in docs.collect():
        counts, failed = base(r.text)
        got = rows[r.doc_id]
        assert {c: got[c] for c in counts} == counts and got.base_failed == failed
        if failed:
            assert not got.kept
        elif r.doc_id in good:
            judged += 1
            right += got.kept == bool(good[r.doc_id])
    assert right >= 0.95 * judged


def test_edges(edge_docs, no_docs):
    field = quality.train([])
    rows = quality.judge(edge_docs, field).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        counts, failed = base(r.text)
        assert {c: r[f"q_{c}"] for c in counts} == counts and r.q_base_failed == failed and r.q_kept == (not failed)
    assert quality.judge(no_docs, field).count() == 0


def test_fit_without_labels_keeps_content(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 0), (2, None, 1), (3, 0, 0), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for docs in (edge_docs, no_docs):
        field = quality.fit(docs, labels)
        assert quality.content_share(field, *quality.describe("some words here")[1:]) == 1.0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_decoding_and_gradient_against_all_paths(n):
    rnd = np.random.default_rng(n)
    features = rnd.normal(size=(n, len(quality.FEATURES)))
    field = quality.LineField(rnd.normal(size=(len(quality.FEATURES), 2)), rnd.normal(size=(2, 2)))

    def score(path, emit, move):
        return sum(features[i] @ emit[:, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product((0, 1), repeat=n))
    best = max(paths, key=lambda p: score(p, field.emit, field.move))
    assert tuple(field.viterbi(features)) == best
    labels = rnd.integers(0, 2, n)
    emit, move = field.gradient(features, labels)

    def likelihood(e, m):
        return score(labels, e, m) - np.logaddexp.reduce([score(p, e, m) for p in paths])

    for i, j in ((0, 0), (3, 1)):
        step = np.zeros_like(field.emit)
        step[i, j] = 1e-5
        slope = (likelihood(field.emit + step, field.move) - likelihood(field.emit - step, field.move)) / 2e-5
        assert abs(slope - emit[i, j]) < 1e-6
    step = np.zeros((2, 2))
    step[0, 1] = 1e-5
    slope = (likelihood(field.emit, field.move + step) - likelihood(field.emit, field.move - step)) / 2e-5
    assert abs(slope - move[0, 1]) < 1e-6


def test_sample_is_of_usable_documents(spark):
    """Labels without a document and long or blank documents use up no place."""
    texts = {i: "fine" if i % 20 < 2 else "long " * 50 if i % 2 else " " for i in range(200)}
    docs = spark.createDataFrame([*texts.items(), (0, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4_000)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 8, 6, 20)
    assert got == [("fine", 0)] * 8 + [("fine", 1)] * 6
    assert len(labelled_sample(docs, labels, "quality", 50, 50, 20)) == 20


def test_sums_of_all_documents_are_those_of_each():
    rnd = np.random.default_rng(4)
    documents = [rnd.normal(size=(n, len(quality.FEATURES))) for n in (1, 4, 2, 7)]
    labels = [rnd.integers(0, 2, len(d)) for d in documents]
    field = quality.LineField(rnd.normal(size=(len(quality.FEATURES), 2)), rnd.normal(size=(2, 2)))
    weight = rnd.random(4)
    together = quality.Sequences.of(documents)
    share, moves = together.sums(field, weight)
    own = np.eye(2)[np.concatenate(labels)]
    emit = together.features.T @ ((own - share) * weight[together.document][:, None])
    want_emit = sum(w * field.gradient(d, y)[0] for d, y, w in zip(documents, labels, weight))
    want_moves = sum(w * (np.eye(2)[y][:-1].T @ np.eye(2)[y][1:] - field.gradient(d, y)[1]) for d, y, w in zip(documents, labels, weight))
    assert np.allclose(emit, want_emit) and np.allclose(moves, want_moves)


def test_lines_keep_their_documents_label_for_the_most_part():
    share = np.array([[0.1, 0.9]] * 5 + [[0.9, 0.1], [0.2, 0.8], [0.7, 0.3]])
    labels = quality.relabelled([np.zeros(5, int), np.ones(3, int)], np.array([0, 1]), share)
    assert labels[0].sum() == 2 and labels[1].tolist() == [0, 1, 1]


def test_planted_boilerplate_is_marked_line_by_line(spark):
    """Lines of bad documents in good ones: most of them are marked and hardly any other line."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    good = [r.text.split("\n") for r in rows if r.quality == 1 and r.text.count("\n") >= 4]
    noisy = [line for r in rows if r.quality == 0 for line in r.text.split("\n") if any(c in line for c in "#*$%&|<>!")]
    rnd = np.random.default_rng(3)
    marked = others = lines = 0
    for i, text in enumerate(good):
        at = int(rnd.integers(0, len(text) + 1))
        planted = [*text[:at], noisy[i % len(noisy)], *text[at:]]
        kinds = field.viterbi(quality.describe("\n".join(planted))[1])
        full = [k for k, line in enumerate(planted) if line.split()]
        marked += sum(kind == 0 for k, kind in zip(full, kinds) if k == at)
        others += sum(kind == 0 for k, kind in zip(full, kinds) if k != at)
        lines += len(full) - 1
    assert len(good) > 50 and marked >= 0.7 * len(good) and others <= 0.02 * lines
