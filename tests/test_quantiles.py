import random

import pytest
from pyspark.sql import functions as F

from winnow.operators.quantiles import percentiles

SHARES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}


def _expected(df, *by):
    return df.groupBy(*by).agg(*[F.expr(f"percentile(v, {q})").alias(name) for name, q in SHARES.items()])


@pytest.mark.parametrize("kind", ["whole", "wild", "ties"])
def test_equal_to_percentile(spark, kind):
    rng = random.Random(kind)
    draw = {
        "whole": lambda: float(rng.randrange(5000)),
        "wild": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-12, 12),
        "ties": lambda: rng.choice([0.0, 0.25, 0.25, 7.0, -3.5, None]),
    }[kind]
    rows = [(rng.choice(["hot", "hot", "b", None, "one"]) if k else "single", draw()) for k in range(6000)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: tuple(r)[1:] for r in percentiles(df, F.col("v"), SHARES, "k").collect()}
    want = {r["k"]: tuple(r)[1:] for r in _expected(df, "k").collect()}
    assert got == want and len(got) == 6
    assert [tuple(r) for r in percentiles(df, F.col("v"), SHARES).collect()] == [tuple(r) for r in _expected(df).collect()]


def test_empty_infinite_and_one_value(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert percentiles(empty, F.col("v"), SHARES, "k").count() == 0
    assert [tuple(r) for r in percentiles(empty, F.col("v"), SHARES).collect()] == [(None,) * 5]
    ends = spark.createDataFrame([(float("-inf"),), (float("inf"),), (1.0,)], "v double")
    assert tuple(percentiles(ends, F.col("v"), {"a": 0.0, "b": 0.5, "c": 1.0}).first()) == (float("-inf"), 1.0, float("inf"))
    many = spark.range(100_000).select(F.lit(5).alias("v"))
    assert tuple(percentiles(many, F.col("v"), {"m": 0.5}).first()) == (5.0,)


def test_plan_holds_no_group_whole(spark):
    plan = percentiles(spark.range(100).select(F.col("id").alias("v")), F.col("v"), {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_set" not in plan
