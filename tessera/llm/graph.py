"""Connected components of an edge table, by repeated stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each vertex's component, for all vertices with an edge.

    ``edges`` has columns a and b. Each round links every vertex's larger neighbours to its least
    neighbour and then its smaller ones to the least of them; rounds go on until nothing changes,
    about the logarithm of the largest component. A vertex's neighbours are never gathered: the
    least one is an aggregate, joined back to the edges.
    """
    stars = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours larger than v point to the least of v and its neighbours
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: v and its smaller neighbours point to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(low.select("v", F.col("m").alias("u"))).filter("v != u").distinct())
        old, stars = stars, saved(small, "stars")
        discard(old)
        # a table of stars has one edge per vertex, and no vertex that is both a leaf and a centre
        n, state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or not n:
            break
        before = state
    return stars.select("v", F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())
