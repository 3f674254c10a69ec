"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b) of longs; root is the least node of the component.

    Each turn re-hangs edges below the least neighbour, first those upwards, then those downwards, and
    takes a number of turns that grows with the logarithm of the nodes.  Counts and sums tell
    when nothing moves any more; the edges themselves stay distributed, and joins treat nodes with very many
    neighbours apart.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
        large = joined(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "cc-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        moved = written(small.filter("u <> v").distinct(), "cc-edges")
        now = moved.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("u").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first()
        for done in (edges, least, large):
            discard(done)
        edges = moved
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
