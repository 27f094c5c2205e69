"""Connected components of a link table, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the smallest node that it reaches.

    Alternates large-star and small-star steps; each links a node's neighbours to the smallest it knows, so that paths
    shorten geometrically and no neighbourhood is gathered: both steps are a minimum for each node and a join, of which
    the first combines before it shuffles and the second can be split where a node is hot. Lineage is cut after each
    round, and only a count and a sum of hashes reach the driver.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None if not links.isEmpty() else (0, None)
    while before != (0, None):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = cut_lineage(small.filter("a <> b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
