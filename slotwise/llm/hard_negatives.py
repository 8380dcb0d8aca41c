"""Hard negatives: exact windowed searches over Hilbert-ordered blocks with zone maps.

Vectors are put in the order of a Hilbert curve through all of their dimensions, so that neighbours on the
curve are neighbours in space, and cut into blocks of BLOCK_ROWS. A block's zone map has the least and the
greatest value of every dimension and the rows of each label. Interval arithmetic on a zone map bounds the inner
products that an anchor can have with the block's rows, from below and from above. The lower bounds alone
give a threshold that the k-th best row must reach; only blocks whose bounds meet the window and the
threshold are read for that anchor. Bounds are exact, so nothing is lost; vectors without any
structure in space simply have more blocks to read.

The blocks lie in Parquet, sorted by block; zone maps are a table of their own, so choosing does not touch vectors.
Anchors and blocks meet in cells of bounded size: CHUNK_ANCHORS anchors and the blocks of one page that any of
them needs. What an anchor finds in a cell is cut to its best k rows there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from slotwise.sources.staging import stage

#: Bits per dimension of the curve's cells.
CURVE_BITS = 2
#: Rows of a block, blocks of a page of vectors, blocks of a page of zone maps, anchors of a chunk.
BLOCK_ROWS, PAGE_BLOCKS, ZONE_PAGE_BLOCKS, CHUNK_ANCHORS = 256, 16, 1_024, 4_096
#: Scores of so many anchors are in memory at a time.
ANCHOR_SLICE = 256
#: Parts (scaled) of this size or more take no part: scores could exceed 64 bits.
TOO_LARGE = 1 << 24

_LEAST, _MOST = -(1 << 62), 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (rows x dimensions, below 2^bits), as bytes to be compared.

    By the transposition of axes: the highest bits of all dimensions come first.
    """
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    if not len(x):
        return np.zeros((cells.shape[0], 0), np.uint8)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = np.uint32(bit - 1)
        for axis in x:
            upper = (axis & np.uint32(bit)) != 0
            swap = np.where(upper, np.uint32(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(upper, low, swap)
            axis ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & np.uint32(bit)) != 0, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _cells(vectors: np.ndarray) -> np.ndarray:
    """Curve cells of vectors: each dimension in parts of the vector's own mean size."""
    size = np.sqrt(np.mean(vectors.astype(float)**2, axis=1, keepdims=True))
    scaled = np.divide(vectors, size, out=np.zeros(vectors.shape), where=size > 0)
    half = 1 << (CURVE_BITS - 1)
    return np.clip(np.floor(scaled + half), 0, 2 * half - 1).astype(np.uint32)


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _by_dims(batch) -> Iterator[tuple[int, np.ndarray]]:
    """Dimensions that occur in a batch, and the rows that have them."""
    sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        yield int(dims), np.flatnonzero(sizes == dims)


def usable_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, dims, vector (whole numbers floor(256 x)) of the rows that take part, one per vec_id."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(TOO_LARGE >> 8)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       scaled.cast("array<int>").alias("vector"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", F.size("row.vector").alias("dims"), "row.vector")


def hilbert_blocks(rows: DataFrame, anchor: Column) -> tuple[DataFrame, DataFrame]:
    """The rows in the curve's order with `block`, and the anchors among them with `chunk`; both count from 0."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at in _by_dims(batch):
                part = batch.take(pa.array(at))
                packed = hilbert_keys(_cells(_matrix(part.column("vector"), dims)), CURVE_BITS)
                width = packed.shape[1]
                places = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(width), len(at), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, places], [*part.schema.names, "curve"])

    schema = "vec_id long, label long, dims int, vector array<int>, curve binary"
    order = ("dims", "curve", "vec_id")
    keyed = stage(rows.mapInArrow(keys, schema), "curve")
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("curve")
    ordered = stage(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("anchor", anchor), "ordered")
    # Ranks over all partitions: the place in the partition and what the partitions before it hold. Anchors have their own.
    part = F.shiftright("at", 33)
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("anchor").cast("long")).alias("anchors"))
    bases = stage(sizes.select("part", *(
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in ("rows", "anchors"))), "bases")
    # One row per partition: a bounded table.
    placed = ordered.withColumn("part", part).join(F.broadcast(bases), "part")
    rank = F.col("rows_base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    shape = ("vec_id", "label", "dims", "vector")
    blocks = stage(placed.select(*shape, F.floor(rank / BLOCK_ROWS).alias("block")), "blocks")
    anchors = stage(placed.where("anchor").select(
        *shape, F.floor((F.col("anchors_base") + in_part) / CHUNK_ANCHORS).alias("chunk")), "anchors")
    return blocks, anchors


def zone_maps(blocks: DataFrame) -> DataFrame:
    """Per block and dims: lows, highs (per dimension), labels with their counts."""
    shape = "block long, dims int, lows array<int>, highs array<int>, labels array<long>, counts array<long>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("block").to_numpy()
            for dims, at in _by_dims(batch):
                part = batch.take(pa.array(at))
                matrix, own = _matrix(part.column("vector"), dims), named[at]
                labels = part.column("label").to_numpy()
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                lows, highs = np.minimum.reduceat(matrix, starts), np.maximum.reduceat(matrix, starts)
                counted = [np.unique(x, return_counts=True) for x in np.split(labels, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[starts]), pa.array(np.full(len(starts), dims, np.int32)), pa.array(list(lows), pa.list_(pa.int32())),
                     pa.array(list(highs), pa.list_(pa.int32())), pa.array([v for v, _ in counted], pa.list_(pa.int64())),
                     pa.array([c for _, c in counted], pa.list_(pa.int64()))],
                    ["block", "dims", "lows", "highs", "labels", "counts"])

    def merge(parts: pa.Table) -> pa.Table:
        dims = parts["dims"][0].as_py()
        lows, highs = _matrix(parts["lows"], dims).min(axis=0), _matrix(parts["highs"], dims).max(axis=0)
        labels = parts["labels"].combine_chunks().flatten().to_numpy()
        values, at = np.unique(labels, return_inverse=True)
        counts = np.bincount(at, parts["counts"].combine_chunks().flatten().to_numpy()).astype(np.int64)
        return pa.table([[parts["block"][0].as_py()], pa.array([dims], pa.int32()), pa.array([lows], pa.list_(pa.int32())),
                         pa.array([highs], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.int64())),
                         pa.array([counts], pa.list_(pa.int64()))],
                        ["block", "dims", "lows", "highs", "labels", "counts"])

    parts = blocks.select("block", "dims", "label", "vector").mapInArrow(partial, shape)
    return stage(parts.groupBy("block", "dims").applyInArrow(merge, shape), "zones")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:  # whole numbers that double precision holds exactly
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of anchors (rows) with blocks (columns), by interval arithmetic."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lows) + products(down, highs), products(up, highs) + products(down, lows)


def _zone_arrays(zones: pa.Table, anchor_labels: np.ndarray, dims: int, same: bool):
    """lows, highs, and for each anchor and block the rows with the anchor's label (or without it)."""
    lows, highs = _matrix(zones["lows"], dims), _matrix(zones["highs"], dims)
    counts = zones["counts"].combine_chunks()
    per = pc.list_value_length(counts).to_numpy(zero_copy_only=False)
    block = np.repeat(np.arange(len(per)), per)
    values, own = np.unique(anchor_labels, return_inverse=True)
    labels, flat = zones["labels"].combine_chunks().flatten().to_numpy(), counts.flatten().to_numpy()
    at = np.minimum(np.searchsorted(values, labels), len(values) - 1)
    hit = values[at] == labels
    table = np.zeros((len(values), len(per)), np.int64)
    np.add.at(table, (at[hit], block[hit]), flat[hit])
    return lows, highs, table[own] if same else np.bincount(block, flat, len(per)).astype(np.int64) - table[own]


def _windows(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Window number, anchors that have such a window, its lowest and highest scores."""
    lows, highs = (rows[c].combine_chunks() for c in ("from", "to"))
    per = pc.list_value_length(lows).to_numpy(zero_copy_only=False)
    first = np.cumsum(per) - per
    low, high = lows.flatten().to_numpy(), highs.flatten().to_numpy()
    for w in range(int(per.max(initial=0))):
        has = np.flatnonzero(per > w)
        yield w, has, low[first[has] + w], high[first[has] + w]


def search(anchors: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, k: int) -> DataFrame:
    """The first k rows of each anchor's windows: anchor_id, window, rank (from 1), vec_id, score.

    anchors: vec_id, label, dims, vector, chunk, and the windows' lowest and highest scores as arrays `from` and `to`.
    Rows with the anchor's label are searched if `same`, else those with another one; the anchor itself never.
    """
    zones = zones.withColumn("zone_page", F.floor(F.col("block") / ZONE_PAGE_BLOCKS))

    def every(rows: DataFrame, of: DataFrame, number: str) -> DataFrame:
        """The rows once for each number of the other table that has their dims; these numbers are a range."""
        span = of.groupBy(F.col("dims").alias("of_dims")).agg(F.min(number).alias("lowest"), F.max(number).alias("highest"))
        return rows.join(stage(span, "span"), F.col("dims") == F.col("of_dims")).withColumn(
            number, F.explode(F.sequence("lowest", "highest"))).drop("of_dims", "lowest", "highest")

    asked = stage(every(anchors, zones, "zone_page"), "asked")
    offered = every(zones, anchors, "chunk")
    cell = ("dims", "chunk", "zone_page")

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        """Lower bounds that many rows of a block are sure to reach: the best k per anchor and window."""
        out = {"anchor_id": [], "window": [], "sure": []}
        if len(left) and len(right):
            dims = left["dims"][0].as_py()
            vectors, ids = _matrix(left["vector"], dims), left["vec_id"].to_numpy()
            lows, highs, counts = _zone_arrays(right, left["label"].to_numpy(), dims, same)
            least, most = bounds(vectors, lows, highs)
            if same:
                counts = counts - 1  # the anchor itself may be one of them
            for w, has, low, high in _windows(left):
                for i, a, b in zip(has.tolist(), low.tolist(), high.tolist()):
                    inside = np.flatnonzero((least[i] >= a) & (most[i] <= b) & (counts[i] > 0))
                    if len(inside):
                        best = inside[np.argsort(-least[i, inside], kind="stable")[:k]]
                        sure = np.repeat(least[i, best], np.minimum(counts[i, best], k))[:k]
                        out["anchor_id"].append(ids[i])
                        out["window"].append(w)
                        out["sure"].append(sure.astype(np.int64).tolist())
        return pa.table([pa.array(out["anchor_id"], pa.int64()), pa.array(out["window"], pa.int32()),
                         pa.array(out["sure"], pa.list_(pa.int64()))], ["anchor_id", "window", "sure"])

    sure = asked.groupBy(*cell).cogroup(offered.groupBy(*cell)).applyInArrow(
        floors, "anchor_id long, window int, sure array<long>")
    # The k-th highest of what is sure is a score that the k-th best row reaches at least.
    highest = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"))
    kth = sure.select("anchor_id", "window", F.explode("sure").alias("score")).withColumn(
        "rank", F.row_number().over(highest)).where(F.col("rank") <= k).where(F.col("rank") == k)
    raised = stage(kth.groupBy(F.col("anchor_id").alias("raised_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors")), "floors")
    window_from = F.transform("from", lambda x, i: F.greatest(x, F.coalesce(
        F.try_element_at("floors", i.cast("int")), x)))
    lifted = asked.join(raised, F.col("vec_id") == F.col("raised_id"), "left").withColumn(
        "from", window_from).drop("floors", "raised_id")

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per anchor and page the blocks that one of its windows must read."""
        parts = []
        if len(left) and len(right):
            right = right.sort_by("block")
            dims = left["dims"][0].as_py()
            lows, highs, counts = _zone_arrays(right, left["label"].to_numpy(), dims, same)
            least, most = bounds(_matrix(left["vector"], dims), lows, highs)
            needed = np.zeros(least.shape, bool)
            for _, has, low, high in _windows(left):
                needed[has] |= (most[has] >= low[:, None]) & (least[has] <= high[:, None])
            needed &= counts > 0
            block = right["block"].to_numpy()
            page = block // PAGE_BLOCKS
            starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(page)]):
                who, which = np.nonzero(needed[:, start:end])
                if len(who):
                    rows, counts_of = np.unique(who, return_counts=True)
                    offsets = np.concatenate([[0], np.cumsum(counts_of)]).astype(np.int32)
                    own = left.take(pa.array(rows)).select(["vec_id", "label", "dims", "chunk", "vector", "from", "to"])
                    parts.append(own.append_column("page", pa.array(np.full(len(rows), page[start]))).append_column(
                        "blocks", pa.ListArray.from_arrays(pa.array(offsets), pa.array(block[start:end][which]))))
        return pa.concat_tables(parts) if parts else _empty(chosen_type)

    chosen_type = StructType.fromDDL("vec_id long, label long, dims int, chunk long, vector array<int>, `from` array<long>, "
                                     "`to` array<long>, page long, blocks array<long>")
    chosen = stage(lifted.groupBy(*cell).cogroup(offered.groupBy(*cell)).applyInArrow(choose, chosen_type), "chosen")
    read = chosen.select("dims", "chunk", "page", F.explode("blocks").alias("block")).distinct()
    rows = blocks.select("vec_id", "label", "dims", "vector", "block").join(stage(read, "read"), ["dims", "block"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            dims = left["dims"][0].as_py()
            right = right.sort_by("vec_id")
            ids, labels, block = (right[c].to_numpy() for c in ("vec_id", "label", "block"))
            others = _matrix(right["vector"], dims)
            for start in range(0, len(left), ANCHOR_SLICE):
                part = left.slice(start, ANCHOR_SLICE)
                own_ids, own_labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
                scores = products(_matrix(part["vector"], dims), others)
                asked_for = part["blocks"].combine_chunks()
                of = np.repeat(np.arange(len(part)), pc.list_value_length(asked_for).to_numpy(zero_copy_only=False))
                names, at = np.unique(block, return_inverse=True)
                wanted = np.zeros((len(part), len(names)), bool)
                wanted[of, np.searchsorted(names, asked_for.flatten().to_numpy())] = True
                fits = wanted[:, at] & ((own_labels[:, None] == labels) == same) & (own_ids[:, None] != ids)
                for w, has, low, high in _windows(part):
                    inside = fits[has] & (scores[has] >= low[:, None]) & (scores[has] <= high[:, None])
                    who, which = np.nonzero(inside)
                    value = scores[has[who], which]
                    order = np.lexsort((which, -value, who))  # rows are in the order of their ids
                    who, which, value = who[order], which[order], value[order]
                    rank = np.arange(len(who)) - np.searchsorted(who, who)
                    best = rank < k
                    parts.append(pa.table([
                        pa.array(own_ids[has[who[best]]]), pa.array(np.full(int(best.sum()), w, np.int32)),
                        pa.array(ids[which[best]]), pa.array(value[best])], ["anchor_id", "window", "vec_id", "score"]))
        return pa.concat_tables(parts) if parts else _empty(found_type)

    found_type = StructType.fromDDL("anchor_id long, window int, vec_id long, score long")
    page_cell = ("dims", "chunk", "page")
    found = stage(chosen.groupBy(*page_cell).cogroup(rows.groupBy(*page_cell)).applyInArrow(score, found_type), "found")
    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _empty(schema: StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def hard_negatives(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3,
                   lowest: int = 50, highest: int = 95) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding; other columns are ignored. `label` gives the label to search by, `anchor`
    says which rows are anchors (an expression on vec_id). Scores are inner products of floor(256 x). A
    positive is one of the first `positives` other rows with the anchor's label; its negatives are the first `negatives` rows
    with another label and a score of `lowest` to `highest` percent of the positive's. Higher scores come first, then smaller ids.

    Rows without an id or a label, with a null or empty vector or with a null or non-finite part take no part, nor do
    those with a part of 65,536 or more, whose scores need not fit 64 bits. Vectors of different length are not compared.
    Rows that repeat a vec_id count once: the smallest label, then vector. No rows or no anchors give no rows.
    """
    blocks, asking = hilbert_blocks(usable_rows(vectors, label), F.coalesce(anchor, F.lit(False)))
    zones = zone_maps(blocks)

    def longs(*values: int) -> Column:
        return F.array(*(F.lit(v).cast("long") for v in values))

    near = stage(search(asking.withColumn("from", longs(_LEAST)).withColumn("to", longs(_MOST)), blocks, zones, True, positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    # A negative positive score leaves no window, since its limits are the wrong way round.
    low, high = F.expr(f"(positive_score * {lowest} + 99) div 100"), F.expr(f"(positive_score * {highest}) div 100")
    windows = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", low.alias("low"), high.alias("high")))).alias("of"))
    pairs = asking.join(windows, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "dims", "vector", "chunk", F.col("of.low").alias("from"), F.col("of.high").alias("to"))
    found = search(stage(pairs, "windows"), blocks, zones, False, negatives)
    return found.select("anchor_id", (F.col("window") + 1).alias("p_rank"), "rank", F.col("vec_id").alias("negative_id"),
                        F.col("score").alias("negative_score")).join(
        near.select("anchor_id", F.col("rank").alias("p_rank"), "positive_id", "positive_score"), ["anchor_id", "p_rank"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
