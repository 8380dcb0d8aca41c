"""Z-fast trie of conversations: what they share as prefixes, as tables that Spark joins.

A conversation is a sequence of turns. The compacted trie has a node for every sequence that ends
somewhere or at which sequences part; the edge of a node spans the depths (parent's length, own length].
Each node is hashed under its handle, the prefix at the two-fattest depth of that range (the number with
most trailing zero bits). A sequence finds its exit node by fat binary search: one look-up of its prefix
at the two-fattest depth of what is left of the range per step, so log2(turns) joins whatever the trie.

Sequences are inserted in batches in a random order, the first of FIRST_BATCH, each GROWTH times the one before. A
batch groups only the prefixes below the nodes that its sequences have reached. A prefix that many
sequences share has become a node in an early, small batch, so no later batch meets it as one hot key;
nodes of the first batch, whose number is bounded, are broadcast, all others are joined.

Prefixes are named by sums of 128-bit hashes of (place, turn), so that a conversation of any length is hashed
in blocks of turns, never as one row or one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from slotwise.sources.staging import stage

#: Sequences of the first batch, and how many times as many each later batch has.
FIRST_BATCH, GROWTH = 2_048, 32
#: Turns of a conversation that are summed in one group, as a power of two.
BLOCK_SHIFT = 12
#: Conversation ids that are joined to one piece of text before they are hashed.
PIECE_IDS = 1 << 16

#: Words of a turn's text.
WORD = r"[^\x20\x09-\x0D]+"
#: Name of the empty prefix.
ROOT = "root"
_SUMS = ("s0", "s1", "s2", "s3")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with most trailing zero bits; low < high."""
    shift = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n (turns of the conversation), digest and words of each turn.

    Ordered by turn, null first, then role, then a hash of the text. Ordered by ranges, so that a
    conversation with many turns is dealt over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ("conv_id", "turn", "role", "digest")
    rows = stage(rows, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(rows.select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("at")), "ordered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy("conv_id")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("size").over(before), F.lit(0))).alias("base"),
                         F.sum("size").over(own).alias("n"))
    return stage(rows.join(stage(parts, "parts"), ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("base") + 1).alias("place"), "n", "digest", "words"), "places")


def rebuild(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: (conv_id, length) and (conv_id, d, length, digest, words).

    Of conversation c the first h = crc32(c) % most turns are those of conversation c - c % every (all if it has
    fewer, none if it is absent), then c's own turns after its first h follow.
    """
    head = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    convs = rows.where("place = 1").select("conv_id", "n")
    heads = stage(rows.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(
        F.col("conv_id").alias("base"), "place", F.col("n").alias("base_n"), "digest", "words"), "heads")
    sizes = heads.where("place = 1").select("base", "base_n")
    convs = stage(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", head).join(
        sizes, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), F.greatest(
            F.lit(0), F.col("n") - F.col("h")).alias("kept")), "conversations")
    length = F.col("taken") + F.col("kept")
    borrowed = convs.where("taken > 0").join(heads.drop("base_n"), "base").where("place <= taken").select(
        "conv_id", F.col("place").alias("d"), length.alias("length"), "digest", "words")
    # Joined by stretches of turns, so that a long conversation is no hot key.
    block = F.shiftright(F.col("place") - 1, BLOCK_SHIFT)
    spans = convs.where("kept > 0").select("conv_id", "h", "taken", "kept", F.explode(F.sequence(
        F.lit(0).cast("long"), F.shiftright(F.col("h") + F.col("kept") - 1, BLOCK_SHIFT))).alias("block"))
    own = rows.withColumn("block", block).join(spans, ["conv_id", "block"]).where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("d"), length.alias("length"), "digest", "words")
    return convs.select("conv_id", length.alias("length")), stage(borrowed.unionByName(own), "rebuilt")


def prefixes(turns: DataFrame) -> DataFrame:
    """Of conv_id, d, length, digest, words: conv_id, d, length, key (of the first d turns), words, words_to (of all d)."""
    place = F.md5(F.concat_ws(":", "digest", "d"))
    terms = [F.conv(F.substring(place, 1 + 8 * i, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(_SUMS)]
    rows = turns.select("conv_id", "d", "length", "words", *terms, F.shiftright(F.col("d") - 1, BLOCK_SHIFT).alias("block"))
    summed = (*_SUMS, "words")
    totals = rows.where(F.col("length") > 1 << BLOCK_SHIFT).groupBy("conv_id", "block").agg(
        *(F.sum(c).alias(c) for c in summed))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in summed))
    within = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "d", "length", "block", "words", *(F.sum(c).over(within).alias(f"{c}_own") for c in summed))
    joined = rows.join(totals, ["conv_id", "block"], "left")
    to = {c: F.col(f"{c}_own") + F.coalesce(f"{c}_before", F.lit(0)) for c in summed}
    return stage(joined.select(
        "conv_id", "d", "length", F.md5(F.concat_ws(":", "d", *(to[c] for c in _SUMS))).alias("key"), "words",
        to["words"].alias("words_to")), "prefixes")


def join_nodes(rows: DataFrame, key: str, nodes: DataFrame, on: str) -> DataFrame:
    """Left join of nodes, whose column `early` marks those of the first batch.

    Hot keys belong to early nodes, whose number is bounded: they are broadcast. The rows they match take no part in
    the shuffled join: they get a key of their own.
    """
    names = [c for c in nodes.columns if c not in (on, "early")]
    early = nodes.where("early").select(F.col(on).alias("__on_early"), *(F.col(c).alias(f"__early_{c}") for c in names))
    late = nodes.where("not early").select(F.col(on).alias("__on_late"), *(F.col(c).alias(f"__late_{c}") for c in names))
    rows = rows.join(F.broadcast(early), F.col(key) == F.col("__on_early"), "left")
    met = F.col("__on_early").isNotNull()
    rows = rows.withColumn("__rest", F.when(met | F.col(key).isNull(), F.concat_ws(
        " ", F.lit("-"), F.xxhash64(*rows.columns[:2]))).otherwise(F.col(key)))
    rows = rows.join(late, F.col("__rest") == F.col("__on_late"), "left")
    return rows.select(*(c for c in rows.columns if not c.startswith("__")), *(
        F.coalesce(f"__early_{c}", f"__late_{c}").alias(c) for c in names))


def locate(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fat binary search: per sequence (rep, length) the length of the longest node that it passes, as `low`."""
    state = stage(batch.select("rep", "length", F.lit(0).cast("long").alias("low"), F.col("length").alias("high")), "search")
    step_paths = paths.select("rep", "d", "key")
    lookup = nodes.select("handle", "key", "len", "parent_len", "early").withColumnsRenamed(
        {"key": "node_key", "len": "node_len"})
    while True:
        open_ = state.where("low < high")
        if open_.isEmpty():
            return state.select("rep", "length", "low")
        probe = open_.withColumn("f", two_fattest(F.col("low"), F.col("high"))).join(
            step_paths.select("rep", F.col("d").alias("f"), F.col("key").alias("probe")), ["rep", "f"])
        met = join_nodes(probe, "probe", lookup, "handle").join(
            step_paths.select("rep", F.col("d").alias("node_len"), F.col("key").alias("own_key")), ["rep", "node_len"], "left")
        passes = F.col("own_key") == F.col("node_key")
        moved = met.select(
            "rep", "length",
            F.when(F.col("node_key").isNull(), F.col("low")).when(passes, F.col("node_len")).otherwise(
                F.col("parent_len")).alias("low"),
            # A node whose handle is met but whose end is not is the exit node: the search is over.
            F.when(F.col("node_key").isNull(), F.col("f") - 1).when(passes, F.col("high")).otherwise(
                F.col("parent_len")).alias("high"))
        state = stage(state.where("low >= high").unionByName(moved), "search")


def insert(batch: DataFrame, paths: DataFrame, nodes: DataFrame, early: bool) -> DataFrame:
    """The nodes of the trie with the sequences (rep, length) of a batch in it."""
    exits = locate(batch, paths, nodes).where("low < length")
    step = paths.select("rep", F.col("d"), F.col("key").alias("first_key"))
    # The node whose edge begins with the sequence's next turn, if there is one.
    first = exits.join(step, (exits["rep"] == step["rep"]) & (step["d"] == exits["low"] + 1)).select(
        exits["rep"], "first_key")
    left = join_nodes(first.select("first_key", "rep"), "first_key", nodes.select(
        "first", "early", "key", "len", "parent_len", F.col("rep").alias("edge_rep")), "first").where(
        "key is not null").select("key", F.col("edge_rep").alias("rep"), "len", F.col("parent_len").alias("low")).distinct()
    # Prefixes below what is reached, of the batch and of the edges that it leaves.
    old = paths.join(left, "rep").where("d > low and d <= len").select(
        "rep", "d", paths["key"], F.when(F.col("d") < F.col("len"), F.col("next_key")).alias("next_key"),
        (F.col("d") == F.col("len")).alias("ends"), "low")
    new = paths.join(exits.select("rep", "low"), "rep").where("d > low").select(
        "rep", "d", "key", "next_key", (F.col("d") == F.col("length")).alias("ends"), "low")
    # An edge may belong to a sequence more than once: by the edge's floor.
    region = stage(old.unionByName(new).withColumn("path", F.concat_ws(":", "rep", "low")), "region")
    vertices = region.groupBy("key").agg(
        F.max("ends").alias("ends"), F.min("next_key").alias("least"), F.max("next_key").alias("most"))
    compact = stage(vertices.where("ends or least <> most").select("key"), "compact")
    along = Window.partitionBy("path").orderBy("d")
    found = region.join(compact, "key").select("key", "rep", "path", "d", "low").distinct().withColumn(
        "parent_len", F.coalesce(F.lag("d").over(along), F.col("low"))).groupBy("key").agg(
        F.min("rep").alias("rep"), F.first("d").alias("len"), F.first("parent_len").alias("parent_len"))
    found = found.withColumn("f", two_fattest(F.col("parent_len"), F.col("len")))
    keys = paths.select("rep", "d", "key")
    named = found.join(keys.select("rep", F.col("d").alias("f"), F.col("key").alias("handle")), ["rep", "f"]).withColumn(
        "g", F.col("parent_len") + 1).join(
        keys.select("rep", F.col("d").alias("g"), F.col("key").alias("first")), ["rep", "g"]).select(
        "key", "rep", "len", "parent_len", "handle", "first")
    # A node that an edge was cut above stays as early as it was.
    was = nodes.select("key", F.col("early").alias("was_early"))
    named = named.join(was, "key", "left").withColumn("early", F.coalesce("was_early", F.lit(early))).drop("was_early")
    kept = nodes.join(named.select("key"), "key", "left_anti")
    return stage(kept.unionByName(named), "nodes")


def build(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the trie of distinct sequences (rep, length > 0): key, rep (a sequence through it), len, parent_len,
    handle, first (key of the edge's first prefix), early."""
    n = sequences.count()
    spark = sequences.sparkSession
    nodes = spark.createDataFrame([], "key string, rep long, len long, parent_len long, handle string, first string, early boolean")
    # A sequence's place in the random order, from 0 to 2^31 - 1; shares of this range are batches.
    drawn = stage(sequences.withColumn("draw", F.xxhash64("rep", F.lit("draw")).bitwiseAND(F.lit((1 << 31) - 1))), "sequences")
    start, size, first = 0, FIRST_BATCH, True
    while n and start < 1 << 31:
        end = min(1 << 31, start + max(1, (size << 31) // n))
        batch = drawn.where((F.col("draw") >= start) & (F.col("draw") < end)).select("rep", "length")
        nodes = insert(batch, paths, nodes, first)
        start, size, first = end, size * GROWTH, False
    return nodes


def ends_digest(members: DataFrame) -> DataFrame:
    """Of key, conv_id: key, ends_sha256 (of the decimal ids in ascending order, joined by commas).

    Ids are joined to pieces where they lie in ranges; one task per key reads the pieces one by one.
    """
    key_type, joined_type = "key string, first long, piece string", "key string, ends_sha256 string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, out = None, [], []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()))],
                ["key", "first", "piece"])
            out.clear()
            return batch

        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (key != own or len(ids) == PIECE_IDS):
                    out.append((own, ids[0], ",".join(map(str, ids))))
                    ids = []
                own = key
                ids.append(conv)
            if out:
                yield flush()
        if ids:
            out.append((own, ids[0], ",".join(map(str, ids))))
            yield flush()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, done = None, None, []
        for batch in batches:
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if key == own:
                    state.update(b",")
                else:
                    if own is not None:
                        done.append((own, state.hexdigest()))
                    own, state = key, hashlib.sha256()
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
                done = []
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    ranges = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = ranges.select("key", "conv_id").mapInArrow(pieces, key_type)
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, joined_type)


def expand(convs: DataFrame, ends: DataFrame, sequences: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every prefix as a row, from the nodes' edges."""
    nodes = nodes.select("key", "early")
    # Each distinct sequence with the nodes that it passes; the root is one of them.
    on_path = join_nodes(paths.select("rep", "d", "key", "words_to"), "key", nodes.withColumn("node", F.lit(1)), "key").where(
        "node = 1").select("rep", F.col("d").alias("len"), "key", "words_to")
    at_root = sequences.select("rep", F.lit(0).cast("long").alias("len"), F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("words_to"))
    passed = stage(on_path.unionByName(at_root).join(sequences, "rep"), "passed")
    marked = nodes.unionByName(convs.sparkSession.createDataFrame([(ROOT, True)], "key string, early boolean"))
    counts = stage(passed.groupBy("key").agg(
        F.sum("n").alias("n_convs"), F.min("rep").alias("owner"), F.count(F.lit(1)).alias("n_sequences")).join(
        marked, "key"), "counts")
    along = Window.partitionBy("rep").orderBy("len")
    below = along.rowsBetween(1, Window.unboundedFollowing)
    rows = join_nodes(passed, "key", counts, "key").withColumn("is_owner", F.col("rep") == F.col("owner"))
    rows = rows.select(
        "*", F.lag("key").over(along).alias("parent_key"), F.lag("owner").over(along).alias("parent_owner"),
        F.lag("len").over(along).alias("parent_len"),
        (F.col("words_to") - F.lag("words_to").over(along)).alias("edge_words"))
    saved = F.when(F.col("is_owner"), (F.col("n_convs") - 1) * F.col("edge_words")).otherwise(0)
    rows = rows.select(
        "*", F.coalesce(F.sum(saved).over(below), F.lit(0)).alias("saved_below"),
        F.max(((F.col("len") == F.col("length")) & (F.col("n_sequences") == 1)).cast("long")).over(
            Window.partitionBy("rep")).alias("leaf"))

    def own(c: str) -> Column:
        return F.max(F.when(F.col("is_owner"), F.col(c))).alias(c)

    summed = stage(rows.groupBy("key").agg(
        F.first("len").alias("len"), own("owner"), own("n_convs"), own("parent_key"), own("parent_owner"), own("parent_len"),
        own("words_to"), F.sum("leaf").alias("n_leaves"), F.sum("saved_below").alias("saved_below")), "summed")
    children = summed.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("children"))
    edges = summed.join(children, "key", "left").join(ends, "key", "left").select(
        "*", F.explode(F.when(F.col("len") == 0, F.array(F.lit(0).cast("long"))).otherwise(
            F.sequence(F.col("parent_len") + 1, F.col("len")))).alias("d"))
    each = edges.join(paths.select(F.col("rep").alias("owner"), "d", "words", F.col("words_to").alias("to")),
                      ["owner", "d"], "left")
    at_end = F.col("d") == F.col("len")
    more = (F.col("n_convs") - 1) * (F.col("words_to") - F.col("to") + F.col("words"))
    return each.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None).cast("long")).when(
            F.col("d") == F.col("parent_len") + 1, F.col("parent_owner")).otherwise(F.col("owner")).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved_below") + F.coalesce(more, F.lit(0))).alias("saved_tokens"),
        F.when(at_end & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(
            F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations (see `rebuild`), from the textless root at depth 0.

    Returns conv_id (smallest member), depth, parent_conv_id (root: null), n_convs (conversations that begin with it),
    n_children, n_leaves (childless prefixes in its subtree), saved_tokens (words that its subtree repeats), ends_sha256
    (of the ids of conversations that end there). conv_id and depth name a prefix.

    `turns` has conv_id, turn, role and text; other columns are ignored. Rows without a conv_id take no part; null
    role and text are empty; a null turn comes first; equal turn numbers are ordered by role and a hash of the text, and
    repeated rows are turns of their own. Without any conversation there are no rows.
    """
    convs, rebuilt = rebuild(in_order(turns), every, most)
    every_path = prefixes(rebuilt)
    turnless = convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("length"))
    members = stage(every_path.where("d = length").select("key", "conv_id", "length").unionByName(turnless), "members")
    # Equal conversations are one sequence from here on.
    sequences = stage(members.groupBy("key").agg(
        F.min("conv_id").alias("rep"), F.first("length").alias("length"), F.count(F.lit(1)).alias("n")).drop("key"), "classes")
    own = every_path.withColumnRenamed("conv_id", "rep").join(sequences.select("rep"), "rep", "left_semi")
    following = own.select("rep", (F.col("d") - 1).alias("d"), F.col("key").alias("next_key"))
    paths = stage(own.join(following, ["rep", "d"], "left"), "paths")
    nodes = build(sequences.where("length > 0").select("rep", "length"), paths)
    return expand(convs, ends_digest(members), sequences, paths, nodes)
