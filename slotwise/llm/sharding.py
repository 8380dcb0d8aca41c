"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents with equal texts are linked. Every shard has a quota of rows, quotas differ by one at most. Linked
documents start coarsely: whole groups are laid end to end over the shards, so only groups at a border are cut, and room for
the other documents is left in every shard. In each round a group's smaller parts ask to move to its largest part, in
every second round to the largest one whose shard has room; between two shards as many move one way as
the other, and more as far as the room goes. Parts only move to where their group is, so a group of n rows never lies in
more than ceil(n / quota) + 1 shards. Rounds end when nothing moves. The other documents, which cut no link
wherever they are, then fill the shards up to their quotas, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import spread_cumsum
from slotwise.operators.joins import salted_join
from slotwise.sources.staging import stage

#: Rows per bucket of a running count, and the fewest buckets; their number grows with the table.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256


def _parts(counts: Column, tie: Column) -> Column:
    """A group's parts in an order: by size, then by a number that changes from round to round."""
    return F.transform(counts, lambda n, i: F.struct(n.alias("n"), F.xxhash64(tie, i).alias("tie"), i.alias("s")))


def _target(parts: Column, room: list[int]) -> Column:
    """The largest part, among those in shards with room if there are any."""
    parts = F.filter(parts, lambda p: p["n"] > 0)
    free = F.array(*(F.lit(x) for x in room))
    roomy = F.filter(parts, lambda p: F.element_at(free, p["s"] + 1) > 0)
    return F.coalesce(F.array_max(roomy), F.array_max(parts))


def _admitted(asked: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """How many may go from shard a to shard b, at place a * shards + b: exchanges first, then into room."""
    shards, room = len(room), list(room)
    out = [0] * (shards * shards)
    for (a, b), n in sorted(asked.items()):
        out[a * shards + b] = min(n, asked.get((b, a), 0))
    for (a, b), n in sorted(asked.items(), key=lambda x: -x[1]):
        more = min(n - out[a * shards + b], room[b])
        out[a * shards + b] += more
        room[a], room[b] = room[a] + more, room[b] - more
    return out


def _one_round(groups: DataFrame, room: list[int], turn: int, buckets: int) -> DataFrame:
    """key, counts, moved: after smaller parts have moved to their group's target as far as admitted."""
    shards = len(room)
    parts = _parts(F.col("counts"), F.xxhash64("key", F.lit(turn)))
    wishes = groups.withColumn("parts", parts)
    wishes = wishes.withColumn("target", _target(F.col("parts"), room if turn % 2 == 0 else [0] * shards))
    movers = F.filter("parts", lambda p: (p["n"] > 0) & (p < F.col("target")))
    wishes = stage(wishes.select("key", "counts", F.col("target.s").alias("to"), movers.alias("movers")), "wishes")
    moves = wishes.where(F.size("movers") > 0).select("key", "counts", "to", F.explode("movers").alias("m")).select(
        "key", "counts", "to", F.col("m.s").alias("from"), F.col("m.n").alias("n"))
    # One number per pair of shards.
    asked = {(r["from"], r["to"]): r["n"] for r in moves.groupBy("from", "to").agg(F.sum("n").alias("n")).collect()}
    limit = F.element_at(F.array(*(F.lit(x).cast("long") for x in _admitted(asked, room))),
                         (F.col("from") * shards + F.col("to") + 1).cast("int"))
    queued = spread_cumsum(moves, ["from", "to"], ["key"], F.col("n"), "before", F.xxhash64("key"), buckets)
    queued = queued.withColumn("moved", F.greatest(F.lit(0).cast("long"), F.least("n", limit - F.col("before"))))
    change = F.array(*(
        F.sum(F.when(F.col("to") == s, F.col("moved")).when(F.col("from") == s, -F.col("moved")).otherwise(0))
        for s in range(shards)))
    changed = queued.groupBy("key").agg(
        F.first("counts").alias("old"), change.alias("change"), F.sum("moved").alias("moved")).select(
        "key", F.zip_with("old", "change", lambda a, b: a + b).alias("counts"), "moved")
    return changed.unionByName(wishes.where(F.size("movers") == 0).select("key", "counts", F.lit(0).cast("long").alias("moved")))


def _loads(groups: DataFrame, shards: int) -> list[int]:
    row = groups.agg(*(F.coalesce(F.sum(F.col("counts")[s]), F.lit(0)).alias(f"s{s}") for s in range(shards))).first()
    return [row[s] for s in range(shards)]


def _bounds(sizes: list[int]) -> list[int]:
    """Running totals, with 0 before the first."""
    out = [0]
    for x in sizes:
        out.append(out[-1] + x)
    return out


def balanced_shards(docs: DataFrame, shards: int = 16, most_rounds: int = 12) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes and 1), text_crc32, shard (from 0), slot (gapless from 0 per shard).

    Shards' counts of rows differ by one at most. A null text is an empty one; all empty texts are one group.
    Null ids and repeated rows are documents like others; within a shard slots follow no order of meaning. Other
    columns are ignored. An empty table gives no rows. Only hashes and sizes of the texts move. A group of any
    size is split over as many shards as it needs; running counts are summed in buckets of rows. Rows are ordered
    by a hash of text and doc_id, so the same documents give the same shards however they are partitioned.

    Propagation usually stops by itself after a few rounds; `most_rounds` bounds it. Each round only improves a layout that
    already keeps all quotas, so a bound costs some cut groups and nothing else.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = stage(docs.select(
        docs["doc_id"].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"),
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("mark", F.xxhash64("key", "doc_id")), "rows")
    total = rows.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    order, by_mark = ["mark", "row"], F.xxhash64("mark")

    # Rows of a group are told apart by their place in it; a lone row is no group.
    sizes = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "sizes")
    own = rows.select("key", "row", "mark")
    linked = stage(salted_join(own, sizes.where("members > 1").select("key"), ["key"]), "linked")
    linked = stage(spread_cumsum(linked, ["key"], order, F.lit(1), "place", by_mark, buckets), "places")
    lone = own.join(sizes.where("members = 1").select("key"), "key").select("row", "mark")

    # Every shard gets an even share of the line of linked rows; a group's counts are what falls into each share.
    line = spread_cumsum(sizes.where("members > 1"), [], ["key"], F.col("members"), "start", F.xxhash64("key"), buckets)
    in_groups = linked.count()
    borders = _bounds([in_groups // shards + (s < in_groups % shards) for s in range(shards)])
    shares = [F.greatest(F.lit(0), F.least(F.col("start") + F.col("members"), F.lit(b)) - F.greatest("start", F.lit(a))).cast("long")
              for a, b in zip(borders, borders[1:])]
    groups = stage(line.select("key", F.array(*shares).alias("counts")), "groups")

    loads, still = _loads(groups, shards), 0
    for turn in range(most_rounds):
        room = [q - x for q, x in zip(quota, loads)]
        after = stage(_one_round(groups, room, turn, buckets), "groups")
        groups = after.drop("moved")
        loads = _loads(groups, shards)
        still = still + 1 if after.where("moved > 0").isEmpty() else 0
        if still == 2:  # neither with the room nor without it
            break

    # The first counts[0] members of a group go to shard 0, the next counts[1] to shard 1, and so on.
    ends = F.transform(F.col("counts"), lambda n, i: F.aggregate(
        F.slice(F.col("counts"), 1, i + 1), F.lit(0).cast("long"), lambda t, x: t + x))
    placed = salted_join(linked, groups.select("key", ends.alias("ends")), ["key"])
    placed = placed.select("row", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"))
    lone = spread_cumsum(lone, [], order, F.lit(1), "turn", by_mark, buckets)
    bounds = _bounds([q - x for q, x in zip(quota, loads)])[1:]
    fill = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= F.col("turn")))
    where = placed.unionByName(lone.select("row", fill.alias("shard")))
    done = rows.join(where.withColumnRenamed("row", "r"), F.col("row") == F.col("r")).drop("r")
    # Another hash than the one whose order filled the shards, or a shard's rows would share a bucket.
    return spread_cumsum(done, ["shard"], order, F.lit(1), "slot", F.xxhash64("mark", F.lit("slot")), buckets).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
