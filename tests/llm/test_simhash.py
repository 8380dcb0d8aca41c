"""SimHash groups against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from slotwise.llm import components, simhash
from slotwise.llm.queries import LLM_QUERIES


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """Union-find over all pairs: root per place."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 2


def want_groups(rows):
    """component_id per row for rows of (doc_id, text)."""
    marks = sorted({fingerprint(t) for _, t in rows})
    root = dict(zip(marks, groups(marks, near)))
    ids = {}
    for d, t in rows:
        ids.setdefault(root[fingerprint(t)], []).append(d)
    return [min((d for d in ids[root[fingerprint(t)]] if d is not None), default=None) for d, t in rows]


def test_op10(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(d, f"{fingerprint(t):016x}", c) for (d, t), c in zip(rows, want_groups(rows))}
    assert {tuple(r) for r in LLM_QUERIES["op10_simhash"](spark, sf_dir).collect()} == want


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = sorted(map(repr, ((d, fingerprint(t), c) for (d, t), c in zip(rows, want_groups(rows)))))
    got = sorted(repr((r.doc_id, r.fingerprint % 2**64, r.component_id)) for r in simhash.simhash_groups(edge_docs).collect())
    assert got == want
    assert simhash.simhash_groups(no_docs).count() == 0
    kept = simhash.keep_one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    stay = [r.doc_id for r in kept.collect()]
    assert len(stay) == len(set(want_groups(rows))) == len(set(stay))
    assert set(stay) == set(want_groups(rows))
    assert simhash.keep_one_per_group(no_docs).count() == 0


def _frame(spark, marks):
    return spark.createDataFrame(pa.table({"fingerprint": pa.array(np.array(marks, np.uint64).view(np.int64))}))


@pytest.mark.parametrize(("long_posting", "max_bits"), [(2, 2), (5, 2), (64, 2), (2, 0), (2, 1), (64, 3), (64, 4)])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, long_posting, max_bits):
    monkeypatch.setattr(simhash, "LONG_POSTING", long_posting)
    rnd = random.Random(7)
    marks = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains and clusters of one to three bits' steps
        mark = rnd.choice(marks)
        for _ in range(rnd.randint(1, 3)):
            mark ^= 1 << rnd.randrange(64)
        marks.append(mark)
    marks = sorted(set(marks))
    got = {r.fingerprint % 2**64: r.component for r in simhash.near_duplicates(_frame(spark, marks), max_bits).collect()}
    want = groups(marks, lambda a, b: (a ^ b).bit_count() <= max_bits)
    by_got, by_want = {}, {}
    for m, w in zip(marks, want):
        by_got.setdefault(got[m], set()).add(m)
        by_want.setdefault(w, set()).add(m)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))
    with pytest.raises(ValueError):
        simhash.fingerprint_links(_frame(spark, marks), 5)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_the_minimum_of_shared_places_holds_and_is_met(bits):
    masks, least = simhash.index_places(bits)
    assert len(masks) == 14 and all(m.bit_count() == 32 for m in masks)
    shared = []
    for bad in itertools.combinations(range(8), bits):
        gone = sum(0xFF << 8 * i for i in bad)
        shared.append(sum(not m & gone for m in masks))
    assert min(shared) == least
    # A part of a place survives as well.
    for m in masks:
        parts = simhash._parts_of_place(m, bits)
        for bad in itertools.combinations([i for i in range(8) if not m >> 8 * i & 1], bits):
            assert any(not p & sum(0xFF << 8 * i for i in bad) for p in parts)


def test_pairs_of_one_shared_place_are_no_links(spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    # Four equal bytes only: one shared place.
    marks = sorted({(base & 0xFFFFFFFF) | rnd.getrandbits(32) << 32 for _ in range(20)} | {base, base ^ 3})
    got = {(r.src % 2**64, r.dst % 2**64) for r in simhash.fingerprint_links(_frame(spark, marks), 2).collect()}
    assert {frozenset(p) for p in got} == {frozenset((base, base ^ 3))}


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (7, 6), (6, 7)]
    pairs += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(200)] + [(None, 1)]
    frame = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    nodes = sorted({n for p in pairs[:-1] for n in p})
    links = {frozenset(p) for p in pairs[:-1]}
    root = groups(nodes, lambda a, b: frozenset((a, b)) in links)
    smallest = {}
    for n, r in zip(nodes, root):
        smallest[r] = min(n, smallest.get(r, n))
    assert got == {n: smallest[r] for n, r in zip(nodes, root)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
