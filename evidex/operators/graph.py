"""Graphs as edge tables: bounded search, reachability, cycles and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def bounded_bfs(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, depth of what ``seeds`` (node) reach in at most ``hops`` steps along edges (source, target).

    One join a hop; each node is kept at its first depth, so the frontier only holds new nodes. Edges, frontiers and
    what is reached are stored, so a hop computes nothing of those before it; an empty frontier ends the search.
    """
    edges = stored(edges.select("source", "target"))
    front = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen = front
    for depth in range(1, hops + 1):
        step = front.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.source")).select(F.col("e.target").alias("node")).distinct()
        front = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def fan_metrics(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out (distinct neighbours) and instability fan_out / (fan_in + fan_out)."""
    e = edges.select("source", "target").distinct()
    rows = e.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("target", F.lit(1), F.lit(0)))
    g = rows.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return g.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6))


def trimmed(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that nothing leads to and to nodes that lead nowhere, again and again."""
    e, n = stored(edges.select("source", "target").distinct()), -1
    while (now := e.count()) != n:
        n = now
        ends, starts = e.select(F.col("target").alias("source")).distinct(), e.select(F.col("source").alias("target")).distinct()
        e = stored(e.join(ends, "source", "left_semi").join(starts, "target", "left_semi").select("source", "target"))
    return e


def smallest_reaching(edges: DataFrame) -> DataFrame:
    """node, c of every node of ``edges``: the smallest node that leads to it, itself included."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    labels = stored(nodes.withColumn("c", F.col("node")))
    while True:
        step = edges.join(labels, edges["source"] == labels["node"]).groupBy("target").agg(F.min("c").alias("m"))
        new = stored(labels.join(step, labels["node"] == step["target"], "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("changed")))
        labels = new.select("node", "c")
        if new.where("changed").isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """node, component (smallest member), size of every node on a cycle: nodes that reach one another.

    The smallest node that leads to a node is its label; nodes that lead back to their label, within those of that label, are
    its component. What is left is trimmed and labelled again. No pair of nodes is held but edges, and each
    step is a join on a node.
    """
    e, out = trimmed(edges), edges.select(F.col("source").alias("node"), F.col("source").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    while not e.isEmpty():
        labels = smallest_reaching(e)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))  # noqa: E731, B023
        inner = stored(e.join(of("source"), "source").join(of("target"), "target").where("c_source = c_target").select("source", "target", F.col("c_source").alias("c")))
        members = front = stored(labels.where("node = c"))
        while not front.isEmpty():
            back = inner.join(front.select(F.col("node").alias("target")), "target").select(F.col("source").alias("node"), "c").distinct()
            front = stored(back.join(members.select("node"), "node", "left_anti"))
            members = members.union(front)
        loops = e.where("source = target").select(F.col("source").alias("node"), F.lit(True).alias("loop"))
        sizes = members.groupBy("c").agg(F.count("*").alias("size"))
        rows = members.join(sizes, "c").join(loops, "node", "left").where("size > 1 or loop").select("node", F.col("c").alias("component"), "size")
        out = out.union(stored(rows))
        e = trimmed(e.join(members.select(F.col("node").alias("source")), "source", "left_anti").join(members.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"))
    return out


def tree_closure(nodes: DataFrame, depth: int) -> DataFrame:
    """ancestor, node, distance of nodes (node, parent), each its own ancestor at distance 0."""
    own = nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("long").alias("distance"))
    level, out = own, own
    for d in range(1, depth + 1):
        up = nodes.select(F.col("node").alias("ancestor"), F.col("parent").alias("up"))
        level = level.join(up, "ancestor").where("up is not null").select(F.col("up").alias("ancestor"), "node", F.lit(d).cast("long").alias("distance"))
        out = out.union(level)
    return out
