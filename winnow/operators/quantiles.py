"""Exact quantiles by counting over value ranges.

Spark's `percentile` gathers all distinct values of a group in one task.  Here distinct values are
counted where they lie, and each wanted rank is followed down three levels: ranges that depend on the
value alone (64 an octave), COARSE even parts of the range that holds the rank, and the few distinct
values of that part in order.  What meets in one task is a count for each range, and at the end one
part's values, in a sort that can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Even parts of a range at the second level.
COARSE = 4096


def _octaves(v: Column) -> Column:
    """A number of ranges that never falls as v grows; infinities and NaN, which is last, have their own."""
    inside = F.floor(F.signum(v) * F.log2(F.abs(v) + 1.0) * 64)
    return F.when(F.isnan(v), 1_000_001).when(F.abs(v) == float("inf"), F.signum(v) * 1_000_000).otherwise(inside).cast("int")


def _down(counts: DataFrame, wanted: DataFrame, keys: list[str], part: str) -> DataFrame:
    """wanted (keys, rank, before) with the part that holds each rank, the rows before it, and its ends."""
    upto = F.sum("rows").over(Window.partitionBy(*keys).orderBy(part))
    placed = counts.withColumn("first", upto - F.col("rows")).withColumn("upto", upto)
    held = wanted.join(placed, keys).withColumn("own", F.col("rank") - F.col("before")).filter("own >= first AND own < upto")
    return held.select(*keys, part, "rank", (F.col("before") + F.col("first")).alias("before"), "lo", "hi")


def _counted(live: DataFrame, *keys: str) -> DataFrame:
    return live.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], *by: str) -> DataFrame:
    """One row for each value of `by` (none: one row) with a double column for each share.

    Values between two rows are interpolated as `percentile` does.  Null values do not count; a
    group that has no others has null quantiles, and so has an empty table without `by`.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))  # structs join nulls
    x = df.select(group.alias("g"), value.cast("double").alias("v"))
    c = x.groupBy("g", "v").agg(F.count("*").alias("n")).withColumn("range", _octaves(F.col("v")))
    by_range = _counted(c, "g", "range")
    total = by_range.groupBy("g").agg(F.sum(F.when(F.col("range").isNotNull(), F.col("rows"))).alias("total"))
    places = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in shares.items()}
    ranks = F.array_distinct(F.array(*[f(p) for p in places.values() for f in (F.floor, F.ceil)]))
    wanted = total.filter("total > 0").select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"))

    wanted = _down(by_range.filter("range IS NOT NULL"), wanted, ["g"], "range")
    ends = wanted.select("g", "range", "lo", "hi").distinct()
    inside = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * COARSE), F.lit(COARSE - 1))).otherwise(0)
    live = c.join(ends, ["g", "range"]).select("g", "range", inside.cast("int").alias("part"), "v", "n")
    wanted = _down(_counted(live, "g", "range", "part"), wanted.drop("lo", "hi"), ["g", "range"], "part")
    keys = ["g", "range", "part"]
    last = live.join(wanted.select(*keys).distinct(), keys).select(*keys, "v", F.col("n").alias("rows"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    found = _down(last, wanted.drop("lo", "hi"), keys, "v").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(place: Column) -> Column:
        low, high = F.floor(place), F.ceil(place)
        u, w = F.element_at("at", low), F.element_at("at", high)
        return F.when((low == high) | (u == w), u).otherwise((high - place) * u + (place - low) * w)

    out = total.join(found, "g", "left").select("g", *[between(p).alias(name) for name, p in places.items()])
    if not by:  # an empty table has a row, too
        out = df.sparkSession.range(1).select(group.alias("g")).join(out, "g", "left")
    return out.select(*[F.col("g")[c].alias(c) for c in by], *shares)
