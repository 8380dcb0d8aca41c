"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are ordered by the signs of random projections, read as one number, then each is
compared with the WINDOW vectors after it by its exact cosine; verified pairs are united over all passes.
Vectors that share their first signs and are too many for a window (a hot group of near copies) are compared
all with all, as pairs of blocks that are tasks of their own. So a pair meets in each pass where it shares the
first signs, however the vectors lie, and the number of passes follows from the number of vectors: a pair at
the limit must meet in some pass with probability `recall`. Each vector knows its places in all passes; a pair
counts in the first pass where it meets, so that counts are summed up and no lists of partners are kept.
Equal vectors are compared once, with their number as weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from slotwise.llm.components import connected_components
from slotwise.sources.staging import stage

WINDOW = 1_024
#: Vectors that one task compares at a time, besides the window that follows them.
STRETCH = 2_048
BLOCK = 256
#: A run of vectors with the same first signs is cut into so many blocks, each of one window at least and MOST_SIDE at most.
SIDES, MOST_SIDE = 16, 4_096
#: Signs per sort key, more than the number of vectors needs.
BITS = 48


def _signs(n: int, window: int) -> float:
    """If the vectors lie evenly, half a window of them shares so many first signs."""
    return max(1.0, math.log2(max(2, n) / window) + 1)


def passes_for(n: int, least_cosine: float, recall: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the limit has met with probability `recall`.

    A pair meets at least if its first log2(n / window) + 1 signs agree, each with probability 1 - angle / pi.
    """
    agree = 1 - math.acos(least_cosine) / math.pi
    meet = agree ** _signs(n, window)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision from a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # so that no square is too large or too small
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def near_pairs(unit: np.ndarray, own: range, others: range, window: int | None, least: float,
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i in own, j in others, i < j, with a cosine of at least `least`, some rows of `own` at a time.

    With a window only j <= i + window.
    """
    rough = unit.astype(np.float32)
    for a in range(own.start, own.stop, BLOCK):
        b = min(a + BLOCK, own.stop)
        first = max(a, others.start)
        last = others.stop if window is None else min(others.stop, b + window)
        cosine = rough[a:b] @ rough[first:last].T
        i, j = np.nonzero(cosine >= least - 1e-4)
        sure = cosine[i, j] >= least + 1e-4
        i, j = i + a, j + first
        near = (j > i) if window is None else (j > i) & (j - i <= window)
        i, j, sure = i[near], j[near], sure[near]
        close = np.flatnonzero(~sure)
        sure[close] = np.einsum("ij,ij->i", unit[i[close]], unit[j[close]]) >= least
        yield i[sure], j[sure]


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`root` has a place that each place reaches, the same for all that reach each other; now also by the pairs."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def _unmet(i: np.ndarray, j: np.ndarray, turn: np.ndarray, ranks: np.ndarray, runs: np.ndarray, window: int,
           ) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that did not meet in an earlier pass. ranks, runs: by pass and row; turn: of each row."""
    for t in range(int(turn.max(initial=0))):
        met = np.abs(ranks[t][i] - ranks[t][j]) <= window
        met |= (runs[t][i] == runs[t][j]) & (runs[t][i] >= 0)
        left = ~(met & (turn[i] > t))
        i, j = i[left], j[left]
    return i, j


def _passes(classes: DataFrame, passes: int, signs: int, width: int, least: float, window: int, seed: int) -> DataFrame:
    """Per task and vector with new partners in it: node, found (weight of these partners), root (in the task)."""
    planes = np.random.default_rng(seed).normal(size=(passes, BITS, width))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            unit = _matrix(batch.column("vector"))
            for turn in range(passes):
                key = (unit @ planes[turn].T > 0) @ weight
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), turn), pa.int32()), pa.array(key), batch.column("node")],
                    ["turn", "key", "node"])

    def by_pass(column: pa.ChunkedArray) -> np.ndarray:
        return np.ascontiguousarray(column.combine_chunks().flatten().to_numpy().reshape(-1, passes).T)

    def compare(rows: pa.Table, own: range, others: range, within: int | None) -> pa.Table:
        turn, node, copies = (rows[c].to_numpy() for c in ("turn", "node", "copies"))
        ranks, runs = by_pass(rows["ranks"]), by_pass(rows["runs"])
        run = runs[turn, np.arange(len(node))]
        found, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in near_pairs(_matrix(rows["vector"]), own, others, within, least):
            if within is not None:
                # Those inside a long run are left to its blocks.
                here = (turn[i] == turn[j]) & ((run[i] != run[j]) | (run[i] < 0))
                i, j = i[here], j[here]
            i, j = _unmet(i, j, turn, ranks, runs, window)
            for to, by in ((i, j), (j, i)):
                found += np.bincount(to, copies[by], len(node)).astype(np.int64)
            root = _unite(root, i, j)
        some = np.flatnonzero(found)
        return pa.table({"node": node[some], "found": found[some], "root": node[root[some]]})

    def compare_stretch(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        own = int(np.count_nonzero(rows["rank"].to_numpy() < (rows["stretch"][0].as_py() + 1) * STRETCH))
        return compare(rows, range(own), range(len(rows)), window)

    def compare_blocks(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        own = int(np.count_nonzero(rows["block"].to_numpy() == low))
        return compare(rows, range(own), range(0 if low == high else own, len(rows)), None)

    keyed = classes.select("node", "vector").mapInArrow(keys, "turn int, key long, node long")
    # Staged before the range partitioning, which would compute the keys once more to find its bounds.
    ordered = stage(keyed, "keyed").repartitionByRange("turn", "key", "node").sortWithinPartitions("turn", "key", "node")
    ordered = stage(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    # The rank in the whole order is the place in the partition and the sizes of the partitions before it.
    part = F.shiftright("place", 33)
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "bases")
    ranked = ordered.withColumn("part", part).join(sizes, "part").select(
        "turn", "node", F.shiftright("key", BITS - signs).alias("prefix"),
        (F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    stretch = F.floor(F.col("rank") / STRETCH)
    # Runs that no window spans, named by their first rank; by stretch, so that no join key has more rows than a stretch.
    runs = ranked.groupBy("turn", "prefix").agg(F.min("rank").alias("run"), F.count(F.lit(1)).alias("size")).where(
        F.col("size") > window + 1).select("turn", "prefix", "run", "size", F.explode(F.sequence(
            F.floor(F.col("run") / STRETCH), F.floor((F.col("run") + F.col("size") - 1) / STRETCH))).alias("stretch"))
    at = ranked.withColumn("stretch", stretch).join(stage(runs, "runs"), ["stretch", "turn", "prefix"], "left").groupBy(
        "node").agg(F.array_sort(F.collect_list(F.struct(
            "turn", "rank", F.coalesce("run", F.lit(-1)).alias("run"), F.coalesce("size", F.lit(0)).alias("size")))).alias("at"))
    placed = stage(at.withColumnRenamed("node", "a_node").join(classes, F.col("a_node") == F.col("node")).select(
        "node", "copies", "vector", "at"), "placed")
    each = placed.select("node", "copies", "vector", F.col("at.rank").alias("ranks"), F.col("at.run").alias("runs"),
                         F.explode("at").alias("here")).select("*", "here.*").drop("here")
    # The first rows of a stretch are also the window of the stretch before it.
    halo = (F.col("rank") % STRETCH < window) & (stretch > 0)
    stretches = each.withColumn("stretch", F.explode(
        F.when(halo, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))))
    # Each block of a run with each, itself included.
    side = F.greatest(F.lit(window), F.least(F.lit(MOST_SIDE), F.ceil(F.col("size") / SIDES)))
    blocks = each.where("size > 0").withColumn("block", F.floor((F.col("rank") - F.col("run")) / side)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / side)))).withColumn(
        "low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    shape = "node long, found long, root long"
    return stage(stretches.groupBy("stretch").applyInArrow(compare_stretch, shape).unionByName(
        blocks.groupBy("run", "low", "high").applyInArrow(compare_blocks, shape)), "compared")


def linked_vectors(vectors: DataFrame, least_cosine: float = 0.9, recall: float = 0.995, window: int = WINDOW,
                   seed: int = 17) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    `vectors` has vec_id and embedding; other columns are ignored. No link below the limit, cosines in
    double precision. Null, empty and zero vectors and those with null or non-finite parts link with
    nothing, vectors of different length do not link. Equal vectors all link (also rows with the same
    vec_id). Without a vec_id in its component a row's component_id is null; kept is vec_id = component_id,
    null-safe. An empty table gives no rows.
    """
    if window > STRETCH:
        raise ValueError(f"the window must be at most {STRETCH}")
    parts = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # no negative zeros
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = stage(vectors.select("vec_id", F.when(usable, parts).alias("vector")).withColumn(
        "h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn(
        "h2", F.when(F.col("vector").isNotNull(), F.hash("vector"))), "vectors")
    # Two hashes, 96 bits, name a distinct vector.
    classes = stage(rows.where("vector is not null").groupBy("h1", "h2").agg(
        F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
    ).withColumn("node", F.monotonically_increasing_id()), "classes")
    compared = []
    for size in classes.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect():
        same = classes.where(F.size("vector") == size.width)
        passes = passes_for(size.n, least_cosine, recall, window)
        signs = int(_signs(size.n, window))
        compared.append(_passes(same, passes, signs, size.width, least_cosine, window, seed))
    alone = classes.select("h1", "h2", "node", "first_id", "copies")
    if compared:
        compared = reduce(DataFrame.unionByName, compared)
        links = stage(compared.groupBy(F.col("node").alias("l_node")).agg(F.sum("found").alias("found")), "links")
        groups = connected_components(compared.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
        alone = alone.join(links, F.col("node") == F.col("l_node"), "left").drop("l_node").join(
            groups.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node"), "left")
    else:
        alone = alone.withColumn("found", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    named = stage(alone.select(
        "h1", "h2", "first_id", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select(
        F.col("h1").alias("n1"), F.col("h2").alias("n2"), "n_links", "component_id")
    return rows.join(named, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
