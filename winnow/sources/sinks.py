"""Outputs of cleaning, training and moderation, on any store that Spark writes."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.operators.cleaning import Cleaned, audit, shuffled
from winnow.sources.splits import MANIFEST, SPLITS, split_fingerprints


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small report as one JSON text; a value that is no number raises ValueError."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, quote='"', escape='"', emptyValue="", quoteAll=True)
    else:
        writer.format(kind).save(path)


def write_splits(rows: DataFrame, folder: str, kind: str = "csv", seed: int | None = None) -> None:
    """A table for each split and one of all rows; with a seed every split is in a seeded order."""
    own = rows.select("text", "label", "kaynak", "group_id", "split")
    for split in SPLITS:
        part = own.filter(F.col("split") == split).drop("split")
        write_table(part if seed is None else shuffled(part, seed), f"{folder}/{split}.{kind}", kind)
    write_table(own, f"{folder}/all.{kind}", kind)


def write_manifest(rows: DataFrame, folder: str, version: str) -> dict:
    manifest = {"data_version": version, "preprocessing_version": fixed.PREPROCESSING_VERSION, "split_fingerprints": split_fingerprints(rows)}
    write_json(rows.sparkSession, f"{folder}/{MANIFEST}", manifest)
    return manifest


def write_cleaned(cleaned: Cleaned, output: str, reports: str, kind: str = "csv") -> dict:
    """Splits, manifest, audit, and each quality table that has rows; returns the audit."""
    write_splits(cleaned.rows, output, kind, cleaned.config.seed)
    report = audit(cleaned)
    write_manifest(cleaned.rows, output, report["data_version"])
    write_json(cleaned.rows.sparkSession, f"{reports}/data_audit.json", report)
    for name, df in (("label_conflicts", cleaned.conflicts), ("duplicate_texts", cleaned.duplicates), ("rejected_rows", cleaned.rejected)):
        if not df.isEmpty():
            write_table(df, f"{reports}/{name}.{kind}", kind)
    return report


def write_metrics(metrics: DataFrame, folder: str, names: tuple[str, ...]) -> None:
    """Metrics of each model as a table and as JSON; a missing or undefined metric raises ValueError."""
    rows = [r.asDict() for r in metrics.collect()]  # one per model
    wrong = sorted({f"{r['model']}: {c}" for r in rows for c in names if r[c] is None or not math.isfinite(r[c])})
    if wrong:
        raise ValueError(f"undefined metrics: {', '.join(wrong)}")
    write_table(metrics, f"{folder}/model_comparison.csv")
    write_json(metrics.sparkSession, f"{folder}/model_metrics.json", {r["model"]: {c: r[c] for c in names} for r in rows})


def write_history(history: DataFrame, folder: str, model: str) -> None:
    """Epoch metrics of a training run (epoch and a column for each metric)."""
    write_table(history.orderBy("epoch").coalesce(1), f"{folder}/history_{model}.csv")


def write_model_manifest(spark: SparkSession, path: str, *, model_version: str, threshold: float, artifacts: dict[str, str], **more) -> dict:
    """What serving needs to accept a model; moderation.model_problem() reads it."""
    manifest = {
        "model_version": model_version,
        "preprocessing_version": fixed.PREPROCESSING_VERSION,
        "threshold": threshold,
        "label_mapping": {"0": "clean", "1": "toxic"},
        "artifacts": artifacts,
        **more,
    }
    write_json(spark, path, manifest)
    return manifest


def append_log(messages: DataFrame, path: str) -> None:
    """Moderated messages appended to the log; in a stream, from foreachBatch."""
    messages.write.mode("append").partitionBy("review_status").parquet(path)


def stream_log(messages: DataFrame, path: str, checkpoint: str):
    """Moderated messages of a stream into the log; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
