"""Shards: even counts, gapless slots, few groups cut."""

import zlib
from collections import Counter

import pyarrow as pa
import pytest

from slotwise.llm import sharding
from slotwise.llm.queries import LLM_QUERIES


def check(rows, texts, shards):
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(shards))
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)


def spread(rows):
    """Shards per group of equal texts."""
    own = {}
    for r in rows:
        own.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    return own


def test_op5(spark, sf_dir, docs):
    rows = LLM_QUERIES["op5_label_propagation"](spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 16)
    assert all(len(s) == 1 for s in spread(rows).values())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def _frame(spark, texts):
    return spark.createDataFrame(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))


@pytest.mark.parametrize("texts", [
    ["hot"] * 400 + [f"pair {i // 2}" for i in range(300)] + [f"lone {i}" for i in range(301)],
    [f"group {i % 7}" for i in range(163)],
    ["only"] * 50,
])
def test_large_groups_are_cut_as_little_as_quotas_allow(spark, texts):
    rows = sharding.balanced_shards(_frame(spark, texts), 8).collect()
    check(rows, list(enumerate(texts)), 8)
    own, quota = spread(rows), len(texts) / 8
    sizes = Counter(texts)
    for text, n in sizes.items():
        parts = own[len(text) + 1, zlib.crc32(text.encode())]
        assert len(parts) <= -(-n // quota) + 1
    cut = sum(len(p) > 1 for p in own.values())
    assert cut <= 8 + sum(n > quota for n in sizes.values()), cut


@pytest.mark.parametrize("most_rounds", [0, 12])
def test_partitions_change_nothing(spark, most_rounds):
    frame = _frame(spark, [f"group {i % 7}" for i in range(163)] + ["only"] * 40 + [f"lone {i}" for i in range(20)])
    found = [sorted(map(str, sharding.balanced_shards(frame.repartition(n), 8, most_rounds).collect())) for n in (1, 2, 4, 5, 8)]
    assert all(f == found[0] for f in found)


def test_rounds_join_what_the_borders_cut(spark):
    # Groups of 7 rows do not fit the shares of 52.5 linked rows, but 37 other rows leave room to move.
    texts = [f"group {i // 7}" for i in range(420)] + [f"lone {i}" for i in range(300)]
    before = spread(sharding.balanced_shards(_frame(spark, texts), 8, 0).collect())
    after = spread(sharding.balanced_shards(_frame(spark, texts), 8).collect())
    assert sum(len(s) > 1 for s in before.values()) >= 4
    assert all(len(s) == 1 for s in after.values())


def test_edges(edge_docs, no_docs):
    check(sharding.balanced_shards(edge_docs, 4).collect(), [(r.doc_id, r.text) for r in edge_docs.collect()], 4)
    assert sharding.balanced_shards(no_docs, 4).count() == 0
