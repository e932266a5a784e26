"""Connected components of an edge table, by alternating large and small stars.

Every step is a join and an aggregation over edges; the driver sees only two
sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or its smaller) neighbours to the smallest node it sees."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        found = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        found = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = found.unionByName(least.select("a", F.col("m").alias("b")))
    return found.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node with a link; ``edges`` has long columns ``a`` and ``b``; a component is its smallest node."""
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if (sums.n, sums.sum) == mark or not sums.n:
            break
        mark = sums.n, sums.sum
        now = written(star(star(now, large=True), large=False), "stars")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
