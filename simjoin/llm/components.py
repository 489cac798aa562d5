"""Connected components of a graph that lives in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b) but the roots: root is the smallest node reachable.

    Large-star and small-star steps in turn: each moves a node's neighbours to the smallest
    of them, with sums before the shuffle, so a hub costs no more than its row count. Every
    round's edges are written to the shared folder, where those of the round before are
    deleted; nothing is gathered on the driver but a count and a checksum. Loops and nulls
    are ignored.
    """
    down = lambda df: df.where(F.col("a") > F.col("b")).distinct()
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    edges, before = stored(edges.distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = down(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, stored(down(small), "edges")
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = now
