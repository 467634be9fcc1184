"""Reading of input tables and cutting of lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether a finished job's shuffle files go at once; read when a query's execution is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that goes to Python in such a job: the default of 64 MB takes twice that in each task.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Most bytes of a table that such a job sends to all tasks.  What counts is the compressed file; of sorted ids it has
#: a fiftieth of the hash table that the driver builds, and many of these may be alive at once.
BROADCAST, BROADCAST_BYTES = "spark.sql.autoBroadcastJoinThreshold", 1 << 18
#: Folders of the tables that materialize wrote, by DataFrame.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and all runs here."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="winnow-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone when the interpreter ends
        pass


@contextlib.contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Settings of a job whose memory in driver and tasks does not follow the session's defaults."""
    before = {k: spark.conf.get(k) for k in (CLEANUP, BATCH, BROADCAST)}
    now = before[BROADCAST]
    least = -1 if now.startswith("-") else min(BROADCAST_BYTES, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now))
    try:
        for k, v in ((CLEANUP, "true"), (BATCH, BATCH_BYTES), (BROADCAST, least)):
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that survives lost executors.

    What the job shuffled is removed when it ends.  The table goes with discard, or when the
    driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow-{uuid.uuid4().hex}"
    schema = df.schema
    with bounded(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize gave and that no later plan reads."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            _remove(df.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(carry: tuple[str, ...]) -> Column:
    """The columns a caller wants back, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")


def uncarried(carry: tuple[str, ...], column: str = "_carry") -> list[Column]:
    return [F.col(column).getField(c).alias(c) for c in carry]
