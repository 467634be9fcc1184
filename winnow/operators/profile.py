"""Profiles of labelled tables: counts, shares, histograms and lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.text import tokens
from winnow.operators.quantiles import percentiles


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def largest(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k values with the most rows; ties by value."""
    return counts(df, by).orderBy(F.desc("n"), by).limit(k)


def label_columns(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Rows of label 0 and 1 of each value, as columns."""
    return df.groupBy(by).agg(F.count_if(F.col(label) == 0).alias("clean"), F.count_if(F.col(label) == 1).alias("toxic"))


def label_shares(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    wide = label_columns(df, by, label)
    total = F.col("clean") + F.col("toxic")
    return wide.select(by, *[F.round(F.col(c) / total, 6).alias(f"{c}_share") for c in ("toxic", "clean")])


def totals(**parts: DataFrame) -> DataFrame:
    """metric and n: the rows of each named table."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in parts.items()])


def text_profile(df: DataFrame, text: str = "text", source: str = "source", short: int = 20) -> DataFrame:
    """Rows, null texts, sources, and texts of fewer than short characters."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(text).isNull()).alias("null_texts"), F.count_distinct(source).alias("sources"), F.count_if(F.length(text) < short).alias("tiny"))


def excess_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows beyond the first of their text; null texts are one text."""
    known = F.concat(F.when(F.col(text).isNull(), "n").otherwise("v"), F.coalesce(text, F.lit("")))
    return df.agg((F.count("*") - F.count_distinct(known)).alias("excess"))


def histogram(df: DataFrame, value: Column, bins: int, *by: str) -> DataFrame:
    """Equal bins from the least value to the 99th percentile, the last one closed; share within `by`."""
    x = df.select(*by, value.alias("v"))
    q = percentiles(x, F.col("v"), {"hi": 0.99, "lo": 0.0})  # one row
    own = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).otherwise(0)
    b = x.crossJoin(F.broadcast(q)).filter("v <= hi").select(*by, F.least(own, F.lit(bins - 1)).cast("long").alias("bin"))
    n = counts(b, *by, "bin")
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6)) if by else n


def word_count(text: str = "text") -> Column:
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """size and groups: sizes over the 99th percentile count as that; single tells groups of one row."""
    n = counts(df, group)
    top = percentiles(n, F.col("n"), {"p": 0.99}).select(F.ceil("p").alias("top"))  # one row
    clipped = n.crossJoin(F.broadcast(top)).select(F.least("n", "top").alias("size"), (F.col("n") == 1).alias("single"))
    return clipped.groupBy("size", "single").agg(F.count("*").alias("groups"))


def quartiles(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Quartiles, 99th percentile, least and most of a whole number."""
    q = percentiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "least": 0.0, "most": 1.0}, *by)
    return q.select(*by, *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75", "q99")], *[F.col(c).cast("long").alias(c) for c in ("least", "most")])
