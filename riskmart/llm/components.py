"""Distributed union-find: connected components of an edge table by alternating star operations.

Large-star hangs every larger neighbour of a node on the smallest node of its neighbourhood, small-star
does so for the smaller ones; both are one partially aggregated minimum and one equi-join. The minima are
written before the join: it then reads plain shuffles on both sides, which AQE splits where a hub node holds
many edges (behind an aggregate it would not). Every round is written to the shared folder and read back, so
the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import stored


def _star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (a, smallest of a and its b's) joined back to every (a, b)."""
    low = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    return edges.join(low, "a").select("a", "b", F.least("a", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node of at least one edge: root is the smallest id reachable.

    Ids are of any one orderable type. Null ends and loops are left out, repeated edges change nothing,
    no edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = _star(large)                       # large has a > b throughout
        e = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
