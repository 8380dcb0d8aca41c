"""The z-fast trie against plain Python and SQL."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from check_oracles import compare, tables
from slotwise.llm import prefix_trie

SCHEMA = "text string, conv_id long, role string, turn long, depth string, key int, rep int"


def _plain(rows, every=20, most=4):
    """What the operator returns, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(of)] for c, of in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        built[c] = (*turns.get(c - int(math.fmod(c, every)), [])[:h], *turns[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(of) - 1) * words
            leaves[node[:d]] += not children[node]
    return sorted((
        min(of), len(node), min(members[node[:-1]]) if node else -1, len(of), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c in sorted(of) if len(built[c]) == len(node)).encode()).hexdigest())
        for node, of in members.items())


def _found(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.prefix_trie(frame).collect())


def _frame(spark, rows):
    return spark.createDataFrame([(x, c, r, t, "extra", 1, 2) for c, t, r, x in rows], SCHEMA).repartition(5)


def test_awkward_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3}") for c in range(45) for t in range(c % 7)]
    rows += [(None, 0, "user", "nobody"), (3, None, "system", "first"), (3, 1, None, None), (3, 1, None, None), (4, 2, "", "  "),
             (4, 2, "", "again again"), (-7, 0, "user", "below zero"), (-20, 0, "user", "x"), (60, 5, "user", "word " * 3000),
             (61, 5, "user", "word " * 3000), (1000, 0, "user", "alone"), (1001, 0, "user", "\x00 odd \t\n text")]
    assert _found(_frame(spark, rows)) == _plain(rows)


def test_no_conversations(spark):
    assert _found(_frame(spark, [])) == []
    assert _found(_frame(spark, [(None, 1, "user", "x")])) == []


def test_copies_a_common_first_turn_and_a_long_conversation(spark, monkeypatch):
    # Small first batches and blocks of turns, so that all of them are met.
    monkeypatch.setattr(prefix_trie, "FIRST_BATCH", 5)
    monkeypatch.setattr(prefix_trie, "GROWTH", 3)
    monkeypatch.setattr(prefix_trie, "BLOCK_SHIFT", 3)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 4)
    rows = [(c, t, "user", f"same {t}") for c in range(60) for t in range(4)]
    rows += [(c, 0, "system", "hello") for c in range(60, 120)]
    rows += [(c, t, "user", f"{c % (t + 2)}") for c in range(60, 120) for t in range(1, 6)]
    rows += [(500 + i, t, "user", f"long {t if t < 37 + i else -t}") for i in range(4) for t in range(80)]
    assert _found(_frame(spark, rows)) == _plain(rows)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 3), st.sampled_from("ab"), st.sampled_from(["", "x", "x y"])), max_size=50))
def test_any_conversations(spark, rows):
    assert _found(_frame(spark, rows)) == _plain(rows)


def test_two_fattest(spark):
    rows = spark.range(0, 70).select(F.col("id").alias("a")).join(spark.range(1, 71).select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    for r in rows.select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_query_matches_sql(spark, sf_dir):
    ok, note = compare(spark, tables(sf_dir), "op12_prefix_trie", sf_dir)
    assert ok, note


def test_a_sequence_finds_its_exit_node(spark):
    rows = [(c, t, "user", f"{(c >> (4 - t)) if t < 5 else c}") for c in range(1, 32) for t in range(6)]
    convs, rebuilt = prefix_trie.rebuild(prefix_trie.in_order(_frame(spark, rows)), most=1)
    paths = prefix_trie.prefixes(rebuilt).withColumnRenamed("conv_id", "rep")
    following = paths.select("rep", (F.col("d") - 1).alias("d"), F.col("key").alias("next_key"))
    paths = paths.join(following, ["rep", "d"], "left")
    sequences = convs.select(F.col("conv_id").alias("rep"), "length")
    nodes = prefix_trie.build(sequences.where("rep % 2 = 0"), paths)
    handles = {r.handle: r for r in nodes.collect()}
    assert len(handles) == nodes.count()
    own = {(r.rep, r.d): r.key for r in paths.collect()}
    ends = {r.key for r in handles.values()}
    for r in prefix_trie.locate(sequences, paths, nodes).collect():
        assert r.low == max((d for d in range(1, r.length + 1) if own[r.rep, d] in ends), default=0)


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, partitions):
    rows = [(c, t, "user", f"{c % 5} {t}") for c in range(30) for t in range(3)]
    assert _found(_frame(spark, rows).repartition(partitions)) == _plain(rows)
