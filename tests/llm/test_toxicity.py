"""The recurrent network: gradients, windows, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from slotwise.llm import toxicity
from slotwise.llm.queries import LLM_QUERIES


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 48, 100, 0, 5])
    document, first, inside = toxicity.windows_of(counts)
    base = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        own = [(f - base[d], c) for f, c in zip(first[document == d], inside[document == d])]
        assert {i for f, c in own for i in range(f, f + c)} == set(range(n))
        assert all(f + c <= n for f, c in own)
        assert all(b[0] - a[0] <= toxicity.STRIDE for a, b in zip(own, own[1:]))


def test_gradient():
    net = toxicity.Network.start()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rnd = np.random.default_rng(0)
    vectors = rnd.normal(size=(20, toxicity.WIDTH))
    place, inside = toxicity._places(rnd.integers(0, 20, 60), np.array([0, 10, 55]), np.array([32, 32, 5]))
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        gates = net.gates(vectors)
        states = np.concatenate([
            net.run_side("ahead", gates[:, :3 * toxicity.HIDDEN], place, inside, None),
            net.run_side("back", gates[:, 3 * toxicity.HIDDEN:], place, inside, None)], axis=2)
        logit = net.pool(states, inside)[0]
        return float((weight * (np.logaddexp(0, logit) - label * logit)).sum())

    grads, d_vectors = net.gradient(vectors, place, inside, label, weight)
    for array, grad in [(net.weights[n], g) for n, g in grads.items()] + [(vectors, d_vectors)]:
        for _ in range(3):
            at = tuple(rnd.integers(0, s) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            slope = (up - loss()) / 2e-2
            array[at] = old
            assert abs(slope - grad[at]) < 2e-3 + 2e-2 * abs(slope)


def test_word_rows_pick():
    words = ["a", "bc", "straße", "x" * 500, "日本"]
    rows = toxicity.WordRows.of(words)
    assert rows.counts.tolist() == [1, 3, 7 + 6 + 5, 64 + 63 + 62, 6 + 5 + 4]
    at = np.array([3, 0, 3])
    again, picked = toxicity.WordRows.of([words[i] for i in at]), rows.pick(at)
    assert picked.grams.tolist() == again.grams.tolist() and picked.own.tolist() == again.own.tolist()


def test_long_runs_are_read_in_pieces():
    short = ["a" * 64, "b_c", "日本"]
    assert toxicity.words_of(" ".join(short)) == short
    for n in (65, 96, 97, 128, 500):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(f"x {run}。y")
        assert pieces[0] == "x" and pieces[-1] == "y" and all(len(p) == 32 or p == run[-len(p):] for p in pieces[1:-1])
        assert all(any(run[i:i + 16] in p for p in pieces) for i in range(n - 15))


def _labelled(n=600):
    rnd = np.random.default_rng(1)
    plain = ["w%d" % i for i in range(60)]
    out = []
    for i in range(n):
        words = rnd.choice(plain, rnd.integers(3, 120)).tolist()
        if i % 3 == 0:
            words[rnd.integers(0, len(words))] = "vile" + "".join(rnd.choice(list("abcde"), 4))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_learns_words_by_their_letters():
    rows = _labelled()
    net = toxicity.train(rows[:450])
    found = toxicity.Scorer(net).scores([t for t, _ in rows[450:]]) >= 0.3
    assert (found == np.array([y for _, y in rows[450:]])).mean() > 0.95


def test_toxic_string_late_in_a_long_run():
    scorer = toxicity.Scorer(toxicity.train(_labelled()))
    plain = "_".join("w%d" % (i % 60) for i in range(100))
    for at in (0, 70, 150, len(plain)):
        clean, toxic = scorer.scores([plain, plain[:at] + "_vileabcd_" + plain[at:]])
        assert clean < 0.3 <= toxic


def test_memo_bound_does_not_change_scores(monkeypatch):
    net, texts = toxicity.train(_labelled(90)), [t for t, _ in _labelled(60)]
    whole = toxicity.Scorer(net).scores(texts)
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 40)
    small = toxicity.Scorer(net)
    assert np.allclose(np.concatenate([small.scores([t]) for t in texts]), whole, atol=1e-5)


def test_op6(spark, sf_dir, docs):
    rows = LLM_QUERIES["op6_toxicity"](spark, sf_dir).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_held_out_rows_and_the_pipeline_stage(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    rows = [r for r in LLM_QUERIES["op6_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    hits = sum(r.predicted for r in rows if toxic[r.doc_id])
    assert hits >= 0.8 * sum(toxic[r.doc_id] for r in rows) > 0 and hits >= 0.8 * sum(r.predicted for r in rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, folder).select("doc_id").collect()}
    labelled = {r.doc_id for r in docs.select("doc_id").collect() if toxic.get(r.doc_id)}
    assert len(labelled - kept) >= 0.8 * len(labelled) > 0


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(pa.table({
        "doc_id": pa.array([0, 7, None, 5, 13], pa.int64()), "toxic": pa.array([1, 0, 1, None, 0], pa.int32())}))
    net = toxicity.fit(edge_docs, labels)
    rows = toxicity.score(edge_docs, net).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.t_score == 0 for r in rows if not toxicity.words_of(r.text or ""))
    untaught = toxicity.fit(no_docs, labels)
    assert all(r.t_score < 0.3 for r in toxicity.score(edge_docs, untaught).collect())
    assert toxicity.score(no_docs, net).count() == 0
