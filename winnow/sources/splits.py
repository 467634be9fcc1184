"""Split tables: reading with checks, manifests, digests of files, relational sources."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.functions.text import for_document
from winnow.operators import tables

SPLITS = ("train", "valid", "test")
KNOWN = ("text", "label", "kaynak", "group_id")
MANIFEST = "dataset_manifest.json"


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "csv":  # all columns as strings: a group id of digits keeps its zeros
        return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', emptyValue="")
    return spark.read.format(kind).load(path)


def read_splits(spark: SparkSession, folder: str, kind: str = "csv") -> DataFrame:
    """The known columns of the three split tables, with their split; text and label are required."""
    parts = []
    for split in SPLITS:
        path = f"{folder.rstrip('/')}/{split}.{kind}"
        df = _table(spark, path, kind)
        if missing := {"text", "label"} - set(df.columns):
            raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
        parts.append(df.select(*[F.col(c) for c in KNOWN if c in df.columns]).withColumn("split", F.lit(split)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A JSON file from any store that Spark reads, or None where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_training_splits(spark: SparkSession, folder: str, kind: str = "csv") -> DataFrame:
    """Splits that are fit for training: labels 0 or 1, no empty or repeated text, nothing shared.

    With a manifest beside them the texts are taken as they are (the normal form may not be taken
    twice) and versions and fingerprints must agree; without one the texts are normalised here.
    """
    manifest = read_json(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if manifest is not None and manifest.get("preprocessing_version") != fixed.PREPROCESSING_VERSION:
        raise ValueError(f"normal forms differ: data {manifest.get('preprocessing_version')}, code {fixed.PREPROCESSING_VERSION}")
    df = read_splits(spark, folder, kind)
    text = F.coalesce("text", F.lit("")) if manifest is not None else for_document(F.col("text"))
    number = F.col("label").try_cast("double")
    df = df.withColumn("text", text).withColumn("label", F.when(number.isin(0.0, 1.0), number.cast("byte")))
    each = df.groupBy("split").agg(
        F.count_if(F.col("label").isNull()).alias("labels"), F.count_if(F.col("text") == "").alias("empty"), (F.count("*") - F.count_distinct("text")).alias("repeated")
    )
    for r in each.collect():  # three rows
        for what, message in (("labels", "labels other than 0 and 1"), ("empty", "empty texts"), ("repeated", "repeated texts")):
            if r[what]:
                raise ValueError(f"{r['split']}: {r[what]} {message}")
    if manifest is not None:
        verify(df, manifest)
    tables.check_leakage(df, tuple(c for c in ("text", "group_id") if c in df.columns))
    return df


def split_fingerprints(df: DataFrame) -> dict[str, str]:
    columns = [c for c in KNOWN if c in df.columns]
    return {r["split"]: r["fingerprint"] for r in tables.fingerprint(df, *columns, by=("split",)).collect()}


def verify(df: DataFrame, manifest: dict) -> None:
    """Raise if a split's fingerprint is not the manifest's; splits without one there are not checked."""
    expected, own = manifest.get("split_fingerprints", {}), split_fingerprints(df)
    if wrong := sorted(s for s, f in expected.items() if f and own.get(s) != f):
        raise ValueError(f"fingerprints differ from the manifest: {', '.join(wrong)}")


def file_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path below folder and SHA-256 of each file; a file is hashed in one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    name = F.substring_index(F.col("path"), root, -1)
    return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over all files' names and digests in the order of names; one row per file reaches the driver."""
    digest = hashlib.sha256()
    for r in sorted(file_digests(spark, folder).collect(), key=lambda r: r["path"]):
        digest.update(r["path"].encode())
        digest.update(bytes.fromhex(r["sha256"]))
    return digest.hexdigest()


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, key: str | None = None, parts: int = 8, options: dict[str, str] | None = None, quote: str = '"'
) -> DataFrame:
    """A relational table; with an integer key it is read in parts of equal key ranges.  quote: the store's marks around names."""
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if key is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("query", f"SELECT min({quote}{key}{quote}) AS low, max({quote}{key}{quote}) AS high FROM {table}").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {})).option("dbtable", table)
    if low is None:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()
