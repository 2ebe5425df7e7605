"""Transitive closure of parent links by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studymill.sources.scratch import forget, stored


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, ancestor, depth): every node with itself at depth 0 and each of its ancestors at the least number of steps.

    Pointers are doubled: after round k the pairs of up to 2^k steps and the jumps of exactly 2^k steps are stored, and the
    next round joins either with the jumps; a path of n steps takes log2(n) rounds, whatever the engine's limits on
    recursion are. On a cycle jumps never end, but pairs do: a round without a new pair is the last one. A parent that is
    no node itself is an ancestor without further ones; nodes without id are passed over.
    """
    links = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("id"), F.col(parent).alias("ancestor"))
    up = stored(links.where("ancestor is not null").distinct(), "jumps")
    jumps = up
    every = links.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth")).distinct()
    pairs = stored(every.unionByName(up.where("id <> ancestor").select("id", "ancestor", F.lit(1).cast("long").alias("depth"))), "pairs")
    n, step = pairs.count(), 1
    while True:
        on = jumps.select(F.col("id").alias("start"), F.col("ancestor").alias("via"))
        further = on.join(pairs, on["via"] == pairs["id"]).select(F.col("start").alias("id"), "ancestor", (F.col("depth") + step).alias("depth"))
        grown = stored(pairs.unionByName(further).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "pairs")
        m = grown.count()
        forget(pairs)
        pairs = grown
        if m == n:
            return pairs
        n = m
        ahead = jumps.select(F.col("id").alias("via_id"), F.col("ancestor").alias("far"))
        doubled = stored(on.join(ahead, F.col("via") == F.col("via_id")).select(F.col("start").alias("id"), F.col("far").alias("ancestor")).distinct(), "jumps")
        if jumps is not up:
            forget(jumps)
        jumps, step = doubled, 2 * step


def paths(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, path): positions and names from the root on, as deck trees are sorted. nodes: id, parent_id, position, name; pairs: their closure.

    A node below no root (on a cycle, or under a parent that isn't there) has no path.
    """
    part = nodes.select(F.col("id").alias("of"), F.concat((F.col("position") + 1000000).cast("string"), "name").alias("part"), F.col("parent_id").isNull().alias("root"))
    each = pairs.join(part, pairs["ancestor"] == part["of"])
    got = each.groupBy("id").agg(F.max("root").alias("rooted"), F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "part"))).alias("parts"))  # a row for each level
    return got.where("rooted").select("id", F.array_join("parts.part", "/").alias("path"))
