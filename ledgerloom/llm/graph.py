"""Connected components by alternating large and small stars, each a partial aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, durable


def components(edges: DataFrame) -> DataFrame:
    """From edges (a long, b long): (node, component), the component being its smallest node.

    Nodes without an edge to another node do not appear.  Rounds go on until no edge changes (their number grows
    with the logarithm of a component's size).  Edges are written down after each round, in the shared folder;
    only whether they changed comes to the driver.  A hub's edges meet its one least neighbour in a many-to-one
    join, which Spark splits where it is skewed.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, durable(small.filter("u <> v").distinct(), "cc")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
