"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stored


def connected(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every end of the links (a, b).

    Alternates the two star steps: each node's larger neighbours are hung to its least neighbour, then its smaller ones;
    no node ever gathers a list, so a hub of any size is a group-by with partial aggregation. Ends when nothing moves.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        after = stored(small, "edges")
        # equal sums over (node, parent) twice running: nothing moved
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if now == before or not now[0]:
            break
        before = now
    tops = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return stored(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops), "components")
