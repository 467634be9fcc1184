"""Tables that go through a relational store and back."""

import os
import subprocess
import sys
import uuid
from pathlib import Path

from winnow.sources import embedded, splits

ROOT = str(Path(__file__).resolve().parent.parent)
SCHEMA = "k long, a int, b int"


def test_round_trip_of_parts_nulls_and_nothing(spark, tmp_path):
    rows = [(k, k % 7 if k % 5 else None, -k) for k in range(1000)] + [(None, None, None)] * 3 + [(5, 0, -5), (1 << 40, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    back = embedded.round_trip(df, f"file://{tmp_path}/some", rows=90)
    assert back.dtypes == df.dtypes and back.rdd.getNumPartitions() == 12
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
    none = embedded.round_trip(df.limit(0), f"file://{tmp_path}/none")
    assert none.dtypes == df.dtypes and none.collect() == []


def test_read_in_key_ranges(spark):
    """One store, read in several ranges of its key; this session is one process, so Derby's memory serves."""
    rows = [(k * 3, k % 7, -k) for k in range(100)]
    url, where = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", dict(embedded.OPTIONS)
    spark.createDataFrame(rows, SCHEMA).write.format("jdbc").options(url=url, dbtable="kept", **where).mode("overwrite").save()
    back = splits.read_jdbc(spark, url, "kept", key="k", parts=3, options=where)
    assert back.rdd.getNumPartitions() == 3 and sorted(map(tuple, back.collect())) == rows


def test_query_on_executors_of_their_own(tmp_path):
    """Driver and executors are processes of their own: a store in the memory of one is not seen by the others."""
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
import __spark_entry__
d = "/root/testdata/sf0.001"
got = __spark_entry__.queries()["jdbc_round_trip"](s, d)
want = s.read.parquet(d + "/labels.parquet").select("doc_id", "toxic", "quality")
assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes
print("same rows")
"""
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_SCALA_VERSION": "2.13"}
    for name in [x for x in env if x.startswith(("PYSPARK_GATEWAY", "SPARK_ENV"))]:
        del env[name]
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "same rows" in done.stdout, done.stderr[-3000:]
