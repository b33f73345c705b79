"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need

#: Pointer doublings of a round: chains of up to 2 ** JUMPS links are followed.
JUMPS = 3


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the smallest node reachable.

    Each round every node points to its neighbour (or itself) of least rank, pointers are doubled, and edges are
    carried over to what they point to; edges within a component vanish, so the graph shrinks by a factor each
    round.  The first round ranks by id, which settles stars around their smallest node at once; later rounds rank
    by a hash, so that no order of ids makes long chains.  All neighbours of a hub are reduced before the shuffle
    (min), and joins on a hub are inner equi-joins that Spark can split.  Nothing is collected; loops, repeated
    edges and nulls are dropped; an empty graph gives no rows.
    """
    need(edges, "src", "dst")
    clean = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    graph = scratch.save(clean.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{name}-edges0")
    steps: list[DataFrame] = []
    i = 0
    while not graph.isEmpty():
        rank = F.col("to") if i == 0 else F.xxhash64(F.lit(i), "to")
        both = graph.select(F.col("src").alias("node"), F.col("dst").alias("to")).union(graph.select("dst", "src"))
        least = both.groupBy("node").agg(F.min(F.struct(rank.alias("rank"), "to")).alias("m"))
        own = F.col("node") if i == 0 else F.xxhash64(F.lit(i), "node")
        points = least.select("node", F.when(F.col("m.rank") < own, F.col("m.to")).otherwise(F.col("node")).alias("root"))
        points = scratch.save(points, f"{name}-points{i}-0")
        for k in range(JUMPS if i else 1):
            onto = points.select(F.col("node").alias("root"), F.col("root").alias("further"))
            points = scratch.save(points.join(onto, "root").select("node", F.col("further").alias("root")), f"{name}-points{i}-{k + 1}")
        a = points.select(F.col("node").alias("src"), F.col("root").alias("a"))
        b = points.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        moved = graph.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        graph = scratch.save(moved.distinct(), f"{name}-edges{i + 1}")
        steps.append(points)
        i += 1
    if not steps:
        return edges.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("component")).where("false")

    def then(found: DataFrame, points: DataFrame) -> DataFrame:
        onto = points.select(F.col("node").alias("root"), F.col("root").alias("further"))
        return found.join(onto, "root", "left").select("node", F.coalesce("further", "root").alias("root"))

    found = scratch.save(reduce(then, steps[1:], steps[0]), f"{name}-roots")
    if len(steps) == 1:
        # ranked by id: a root is its component's smallest node unless edges were left
        return found.select("node", F.col("root").alias("component"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.save(found.join(least, "root").select("node", "component"), f"{name}-found")
