"""Graph operators on node and edge tables. Loops run over depth, never over nodes, and expand new nodes only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, once each."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by label: how many, how many point to no node, the largest out-degree."""
    known = nodes.select(F.col("id").alias("dst")).distinct().withColumn("known", F.lit(1))
    degree = edges.join(known, "dst", "left").groupBy("label", "src").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("lost"))
    return degree.groupBy("label").agg(F.sum("n").alias("n_edges"), F.sum("lost").alias("n_unresolved"), F.max("n").alias("max_degree"))


#: A frontier of at most so many rows goes to the edges whole; a larger one meets them by a shuffle.
SMALL_FRONTIER = 500_000


def distances(edges: DataFrame, starts: DataFrame, cutoff: int, by: list[str] | None = None) -> DataFrame:
    """(by..., node, depth): breadth-first distance from the nearest of ``starts`` (by..., node), up to ``cutoff``.

    Edges may repeat: what they reach is made distinct, not they. Only rounds with a large frontier shuffle them.
    """
    by = by or []
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    frontier = cut_lineage(starts.select(*by, "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, cutoff + 1):
        n = frontier.count()
        if not n:
            break
        side = frontier.select(*by, F.col("node").alias("a"))
        reached = both.join(F.broadcast(side) if n <= SMALL_FRONTIER else side, "a").select(*by, F.col("b").alias("node")).distinct()
        frontier = cut_lineage(reached.join(seen.select(*by, "node"), [*by, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, starts: DataFrame, *, by: str, reach: dict[str, int], budget: int) -> DataFrame:
    """(by, node, depth, reason): what labelled edges bring to each start, one from each reason in turn, ``budget`` at most.

    ``reach`` gives the labels to follow and how deep each may be followed. Only what arrived in a round is expanded in
    the next; a node that several reasons bring counts for the first of them.
    """
    frontier = starts.select(by, "node").withColumn("depth", F.lit(0)).withColumn("reason", F.lit("start"))
    seen = frontier
    used = frontier.select(by).distinct().withColumn("used", F.lit(0))
    for depth in range(1, max(reach.values()) + 1):
        open_ = [label for label, deep in reach.items() if deep >= depth]
        step = edges.filter(F.col("label").isin(open_)).select(F.col("src").alias("node"), F.col("dst"), "label")
        found = frontier.select(by, "node").join(step, "node").groupBy(by, F.col("dst").alias("node")).agg(F.min("label").alias("reason"))
        found = found.join(seen.select(by, "node"), [by, "node"], "left_anti")
        turn = found.withColumn("turn", F.row_number().over(W.partitionBy(by, "reason").orderBy("node"))).filter(F.col("turn") <= budget)
        order = turn.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("turn", "reason")))
        kept = order.join(used, by).filter(F.col("place") + F.col("used") <= budget)
        frontier = cut_lineage(kept.select(by, "node", F.lit(depth).alias("depth"), "reason"))
        seen = seen.unionByName(frontier)
        used = seen.filter("depth > 0").groupBy(by).agg(F.count("*").alias("n")).join(used.select(by), by, "right").select(by, F.coalesce("n", F.lit(0)).alias("used"))
    return seen


def levels(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, level): 1 for nodes that need nothing, else 1 + the largest level needed; edges are (node, needs).

    A graph with a cycle never runs dry and is an error after ``limit`` rounds. Layers meet the edges by a merge: a
    broadcast would take each of them through the driver, round after round.
    """
    edges = cut_lineage(edges.select("node", "needs").distinct())
    layer = cut_lineage(nodes.select("node").join(edges.select("node").hint("merge"), "node", "left_anti").distinct())
    out = layer.withColumn("level", F.lit(1))
    for level in range(2, limit + 2):
        layer = cut_lineage(edges.join(layer.withColumnRenamed("node", "needs").hint("merge"), "needs", "left_semi").select("node").distinct())
        if layer.isEmpty():
            return out.groupBy("node").agg(F.max("level").alias("level"))
        out = out.unionByName(layer.withColumn("level", F.lit(level)))
    raise ValueError("the graph has a cycle, or more levels than the limit")


def slice_back(edges: DataFrame, terminal: DataFrame) -> DataFrame:
    """Nodes that feed ``terminal`` (itself included), over edges (node, needs); as many rounds as the graph is deep."""
    seen = frontier = cut_lineage(terminal.select("node").distinct())
    while not frontier.isEmpty():
        frontier = cut_lineage(edges.join(frontier.hint("merge"), "node").select(F.col("needs").alias("node")).distinct().join(seen.hint("merge"), "node", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen
