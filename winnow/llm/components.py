"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(others)


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns u, v with v the least node of u's component, for all nodes but the least ones.

    edges has columns u and v of one orderable type, in any direction; loops and repeats are
    allowed.  Each round writes its edges, whose number never grows beyond that of the input, to
    the shared folder; the driver sees two numbers a round.
    """
    edges = materialize(edges.filter("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before, last = now, edges
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct())
        discard(last)
