"""Links of vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import projection
from slotwise.llm.queries import LLM_QUERIES
from tests.llm.test_simhash import groups


def cosines(x):
    x = np.asarray(x, np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def _frame(spark, ids, vectors, kind=pa.float32()):
    return spark.createDataFrame(pa.table({
        "vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(kind)), "label": [0] * len(ids),
        "n_links": ["clash"] * len(ids)}))


def _clusters(seed, n_clusters=30, most=60):
    rnd = np.random.default_rng(seed)
    rows = [rnd.normal(size=(300, 32))]
    for _ in range(n_clusters):
        centre = rnd.normal(size=32)
        rows.append(centre + rnd.normal(size=(rnd.integers(2, most), 32)) * rnd.uniform(0.05, 0.35))
    return np.concatenate(rows).astype(np.float32)


@pytest.mark.parametrize("window", [1024, 64])
def test_recall_and_no_false_link(spark, monkeypatch, window):
    monkeypatch.setattr(projection, "STRETCH", 256 if window == 64 else 2048)
    x = _clusters(3)
    near = cosines(x) >= 0.9
    np.fill_diagonal(near, False)
    rows = {r.vec_id: r for r in projection.linked_vectors(_frame(spark, list(range(len(x))), list(x)), window=window).collect()}
    found, true = sum(r.n_links for r in rows.values()), int(near.sum())
    assert all(rows[i].n_links <= near[i].sum() for i in rows)
    assert found >= (0.99 if window == 1024 else 0.9) * true
    root = groups(list(range(len(x))), lambda a, b: near[a, b])
    smallest = {}
    for i, r in enumerate(root):
        smallest[r] = min(i, smallest.get(r, i))
    assert sum(rows[i].component_id == smallest[r] for i, r in enumerate(root)) >= 0.99 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_copies_and_edges(spark):
    a, b, c = [1.0, 0.0, 0.0], [2.0, 0.1, -0.0], [0.0, 0.0, 1.0]
    vectors = [a, a, a, b, c, None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [None, 1.0, 0.0],
               [1.0, 0.0], [3.0, 0.0], a, a, [1e-30, 0.0, 0.0]]
    ids = [5, 6, 7, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14, None, 5, 1]
    got = sorted(map(tuple, projection.linked_vectors(_frame(spark, ids, vectors)).collect()), key=repr)
    linked = {5, 6, 7, 2, 1}
    want = []
    for i, v in zip(ids, vectors):
        if i in linked or i is None:
            want.append((i, 6, 1, i == 1))
        elif i in (13, 14):
            want.append((i, 1, 13, i == 13))
        else:
            want.append((i, 0, i, True))
    assert got == sorted(want, key=repr)
    assert projection.linked_vectors(_frame(spark, [], [])).count() == 0
    assert projection.linked_vectors(_frame(spark, [1], [None])).collect()[0].n_links == 0


def test_op9(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    near = cosines([r.embedding for r in rows]) >= 0.9
    got = {r.vec_id: r for r in LLM_QUERIES["op9_projection_passes"](spark, sf_dir).collect()}
    assert [got[r.vec_id].n_links for r in rows] == (near.sum(1) - 1).tolist()


def test_hot_group_of_near_copies(spark, monkeypatch):
    """A cluster several times longer than all windows of all passes together."""
    monkeypatch.setattr(projection, "STRETCH", 256)
    rnd, window, hot = np.random.default_rng(5), 16, 3_000
    x = rnd.normal(size=(hot + 500, 32))
    x[:hot] = rnd.normal(size=32) + rnd.normal(size=(hot, 32)) * 0.2
    x = x[rnd.permutation(len(x))].astype(np.float32)
    near = cosines(x) >= 0.9
    np.fill_diagonal(near, False)
    passes = projection.passes_for(len(x), 0.9, 0.995, window)
    assert hot > 4 * passes * 2 * window and near.sum() > 0.95 * hot * hot
    rows = projection.linked_vectors(_frame(spark, list(range(len(x))), list(x)), window=window).collect()
    assert all(r.n_links <= near[r.vec_id].sum() for r in rows)
    assert sum(r.n_links for r in rows) >= 0.995 * near.sum()
    assert len({r.component_id for r in rows if near[r.vec_id].sum() > 1_000}) == 1


def test_passes_grow_slowly():
    assert projection.passes_for(1_000, 0.9, 0.99) <= projection.passes_for(100_000, 0.9, 0.99) < 40
