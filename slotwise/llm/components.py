"""Connected components by contraction: every round each node joins its first neighbour in a random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.sources.staging import stage


def _order(node: Column, turn: int) -> Column:
    """A new random order of the nodes per round, so that no chain stays long."""
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("o"), node.alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes that occur in the edges `src`, `dst` with the smallest node they reach: node, component.

    Self-links and repeated edges are allowed, null ends are left out; no edges give no rows. Per round a
    node's parent is its neighbour (or itself) that comes first in this round's random order, and edges move
    to the parents; a constant share of nodes goes each round, chains included. Every round is staged in
    the shared folder. Sums per node combine before the shuffle; the two joins that move the edges' ends
    have one row per node on the other side, so Spark can split a hub's edges.
    """
    left = stage(
        edges.where("src is not null and dst is not null").select(
            F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    members = None
    turn = 0
    while True:
        both = left.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            left.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        parents = both.groupBy("node").agg(F.min(_order(F.col("other"), turn)).alias("first")).select(
            "node", F.least(F.col("first"), _order(F.col("node"), turn))["n"].alias("parent"))
        parents = stage(parents, "parents")
        if members is None:
            members = parents.select("node", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("node").alias("__node"), "parent")
            members = members.join(step, members["root"] == step["__node"], "left").select(
                "node", F.coalesce("parent", "root").alias("root"))
        members = stage(members, "members")
        to_src = parents.select(F.col("node").alias("src"), F.col("parent").alias("a"))
        to_dst = parents.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        moved = left.join(to_src, "src").join(to_dst, "dst").where("a <> b").select(
            F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        left = stage(moved, "edges")
        if left.isEmpty():
            break
        turn += 1
    smallest = members.groupBy("root").agg(F.min("node").alias("component"))
    return members.join(smallest, "root").select("node", "component")
