"""Connected components of a distributed list of links, by alternating large-star and small-star.

Each star is an aggregation (combined before the shuffle) and a join back.  The aggregate is a
table of its own before it is joined: with an exchange on both sides, Spark can split the join
at a hub.  Edges go through a table in the shared folder after each star, so lineage
stays short; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def joined_least(both: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``both`` (``u, v``) with ``m``, the least of u and its neighbours, and the table of those."""
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
    return both.join(least, "u"), least


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """Every neighbour that is larger (large star) or not larger (small star) joins the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    joined, least = joined_least(both, scratch, name)
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id that a link (``a, b``) names."""
    turned = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, last, turn = scratch.keep(turned, f"{name}-0"), None, 0
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == last:
            break
        last, turn = (seen["n"], seen["s"]), turn + 1
        half = scratch.keep(_star(edges, True, scratch, f"{name}-least-a"), f"{name}-half")
        edges = scratch.keep(_star(half, False, scratch, f"{name}-least-b"), f"{name}-{turn}")
        for done in (f"{name}-{turn - 1}", f"{name}-half", f"{name}-least-a", f"{name}-least-b"):
            scratch.drop(done)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
