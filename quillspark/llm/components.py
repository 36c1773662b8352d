"""Connected components of a distributed edge list, with DataFrame operations only.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): the number of rounds grows with the logarithm of the longest chain, the edge list
never grows beyond its first size, and every round is a written table in the shared folder, so a
lost executor costs one round at most.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node is hung to the node's smallest neighbour (or itself);
    small: the same for the smaller-or-equal neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    hung = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    return hung.filter("u <> v").distinct()


def connected_components(edges: DataFrame, work: Workspace, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns u, v of one orderable type) whose root,
    the smallest node of its component, is another node.  Nodes without a row are their own roots."""
    now = work.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{label}-0")
    before = None
    for k in range(1, max_rounds + 1):
        now = work.table(_star(_star(now, True), False), f"{label}-{k}")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if k > 1:
            work.drop(f"{label}-{k - 2}")
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
