"""Hard negatives against brute force and SQL; bounds and the curve on their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracles import compare, tables
from slotwise.llm import hard_negatives as hn
from slotwise.llm.defaults import ANCHOR_EVERY, searched_label

SCHEMA = "label int, vec_id long, embedding array<float>, block string, score string, curve int"


def _plain(rows, positives=5, negatives=3):
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        usable[vec_id] = min(usable.get(vec_id, row), row)
    out = []
    for a, (label, vector) in usable.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), i, of) for i, (of, v) in usable.items()
                        if i != a and len(v) == len(vector))
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [(i, -t) for t, i, of in scores if of != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(fits, 1)]
    return sorted(out)


def _found(spark, rows, partitions=4):
    frame = spark.createDataFrame([(l, i, v, "x", "y", 0) for i, v, l in rows], SCHEMA).repartition(partitions)
    return sorted(tuple(r) for r in hn.hard_negatives(frame, searched_label(), F.col("vec_id") % ANCHOR_EVERY == 0).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("PAGE_BLOCKS", 3), ("ZONE_PAGE_BLOCKS", 9), ("CHUNK_ANCHORS", 2), ("ANCHOR_SLICE", 1)):
        monkeypatch.setattr(hn, name, value)


def test_random_and_awkward_rows(spark, small_blocks):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=6).tolist(), int(rnd.integers(0, 10))) for i in range(400)]
    rows += [(400, None, 1), (401, [], 1), (402, [1.0, None] * 3, 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1),
             (405, [1.0] * 6, None), (None, [1.0] * 6, 2), (450, [0.0] * 6, 3), (451, [0.0] * 6, 4), (500, [-1.0] * 6, 5),
             (550, [0.5] * 3, 2), (551, [0.6] * 3, 2), (552, [0.4] * 3, 3), (553, [0.3] * 3, 3), (600, [0.5] * 6, 2), (600, [0.5] * 6, 2),
             (600, [0.2] * 6, 1), (650, [9.0], 4)]
    assert _found(spark, rows) == _plain(rows)


def test_copies_and_ties(spark, small_blocks):
    rnd = np.random.default_rng(4)
    hot = rnd.normal(size=5)
    rows = [(i, (hot if i % 3 == 0 else hot * rnd.integers(1, 4) / 4 if i % 3 == 1 else rnd.normal(size=5)).tolist(), i % 4)
            for i in range(330)]
    assert _found(spark, rows) == _plain(rows)


def test_no_rows(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(1, [1.0, 2.0], 3)]) == []
    assert _found(spark, [(50, [1.0, 2.0], 3)]) == []


@pytest.mark.parametrize("size", [100.0, 60_000.0])
def test_large_parts_are_exact(spark, size):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=4).clip(-1, 1) * size).tolist(), i % 3) for i in range(120)]
    assert _found(spark, rows) == _plain(rows)


def test_query_matches_sql(spark, sf_dir):
    ok, note = compare(spark, tables(sf_dir), "op13_hard_negatives", sf_dir)
    assert ok, note


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in hn.hilbert_keys(grid, bits)]
    assert len(set(keys)) == len(grid)
    path = grid[np.array(sorted(range(len(keys)), key=keys.__getitem__))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met():
    rnd = np.random.default_rng(6)
    a, rows = rnd.integers(-50, 50, (20, 7)), rnd.integers(-50, 50, (40, 7))
    least, most = hn.bounds(a, rows.min(0)[None], rows.max(0)[None])
    scores = a @ rows.T
    assert (least <= scores).all() and (scores <= most).all()
    least, most = hn.bounds(a, rows, rows)
    assert (least == scores).all() and (most == scores).all()


def test_clustered_vectors_leave_blocks_unread(spark, small_blocks, monkeypatch):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rnd.normal(size=8) * 0.02).tolist(), i % 12 % 9) for i in range(600)]
    staged, read = hn.stage, []

    def watch(frame, label):
        out = staged(frame, label)
        if label in ("read", "blocks"):
            read.append((label, out.count()))
        return out

    monkeypatch.setattr(hn, "stage", watch)
    assert _found(spark, rows) == _plain(rows)
    blocks, chunks = -(-600 // 8), -(-12 // 2)
    assert [label for label, _ in read] == ["blocks", "read", "read"]
    assert all(n < blocks * chunks / 2 for label, n in read if label == "read")
