"""Cleaning of labelled rows in one call: rejects, conflicts, duplicates, groups, splits, audit.

Input is the unified form of sources.csv: raw_text, raw_label, text, label, kaynak, dosya,
satir_no, entity_group, red_nedeni (null for accepted rows).
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.functions.text import tokens
from winnow.operators import tables

POLICIES = ("quarantine", "majority", "error")


@dataclass(frozen=True)
class CleaningConfig:
    min_words: int = 1
    max_characters: int = 1500
    test_ratio: float = 0.15
    valid_ratio: float = 0.10
    seed: int = 42
    conflict_policy: str = "quarantine"
    group_near_duplicates: bool = True
    near_duplicate_ratio: float = 0.90
    with_ratio: bool = True

    def __post_init__(self) -> None:
        problems = [
            (self.min_words < 1, "min_words must be at least 1"),
            (self.max_characters < 32, "max_characters must be at least 32"),
            (not (self.test_ratio > 0 and self.valid_ratio > 0), "ratios must be above 0"),
            (not self.test_ratio + self.valid_ratio < 0.5, "the ratios' sum must be below 0.5"),
            (self.conflict_policy not in POLICIES, f"conflict_policy must be one of {', '.join(POLICIES)}"),
            (not (0 < self.near_duplicate_ratio <= 1 and math.isfinite(self.near_duplicate_ratio)), "near_duplicate_ratio must be above 0 and at most 1"),
        ]
        if wrong := [message for bad, message in problems if bad]:
            raise ValueError("; ".join(wrong))


class LabelConflict(ValueError):
    """Texts with several labels under the policy error; conflicts holds their rows."""

    def __init__(self, conflicts: DataFrame, texts: int) -> None:
        super().__init__(f"{texts} texts have several labels")
        self.conflicts = conflicts


@dataclass
class Cleaned:
    """rows have text, label, kaynak, group_id, split; the other tables are for reports."""

    rows: DataFrame
    rejected: DataFrame
    conflicts: DataFrame
    duplicates: DataFrame
    files: DataFrame
    stats: tables.GroupStats
    config: CleaningConfig
    audit: dict = field(default_factory=dict)


def divided(df: DataFrame, reason: str = "red_nedeni") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows: every row is in one of the two."""
    return df.filter(F.col(reason).isNull()), df.filter(F.col(reason).isNotNull())


def resolved(df: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """Rows left by a conflict policy, and all rows of texts with several labels."""
    conflicts = df.join(tables.conflict_texts(df), "text", "left_semi")
    if policy == "error":
        many = conflicts.select("text").distinct().count()
        if many:
            raise LabelConflict(conflicts, many)
        return df, conflicts
    return (tables.majority if policy == "majority" else tables.quarantine)(df), conflicts


def file_reports(df: DataFrame) -> DataFrame:
    """For each file: raw, accepted, rejected, disagreeing, truncated rows and label counts.

    was_truncated and disagrees may be missing; raw labels count as text, a null as <NULL>.
    """
    flags = {c: F.col(c) if c in df.columns else F.lit(False) for c in ("was_truncated", "disagrees", "placeholder")}
    accepted = F.col("red_nedeni").isNull()
    counts = df.groupBy("kaynak", "dosya").agg(
        F.count("*").alias("raw_rows"),
        F.count_if(accepted).alias("accepted_rows"),
        F.count_if(~accepted).alias("rejected_rows"),
        F.count_if(F.coalesce(flags["disagrees"], F.lit(False))).alias("annotator_disagreement_rows"),
        F.count_if(F.coalesce(flags["placeholder"], F.lit(False))).alias("placeholder_annotation_rows"),
        F.count_if(accepted & F.coalesce(flags["was_truncated"], F.lit(False))).alias("truncated_rows"),
        F.count_if(accepted & (F.col("label") == 0)).alias("label_0"),
        F.count_if(accepted & (F.col("label") == 1)).alias("label_1"),
    )
    raw = df.groupBy("kaynak", "dosya", F.coalesce(F.col("raw_label").cast("string"), F.lit("<NULL>")).alias("l")).agg(F.count("*").alias("n"))
    # one entry per distinct raw label of a file
    histogram = raw.groupBy("kaynak", "dosya").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias("raw_labels"))
    prints = tables.fingerprint(df, "raw_text", "raw_label", by=("kaynak", "dosya"))
    keys = ["kaynak", "dosya"]
    return counts.join(histogram, keys).join(prints, keys)


def clean(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> Cleaned:
    """All steps; LabelConflict under the policy error, ValueError on too few groups or on leakage."""
    df = tables.stored(df)  # read by every step and report below
    accepted, rejected = divided(df)
    left, conflicts = resolved(accepted, config.conflict_policy)
    conflicts, duplicates = tables.stored(conflicts), tables.stored(tables.duplicate_rows(left))
    unique = tables.first_rows(left)
    stats = None
    if config.group_near_duplicates:
        grouped, stats = tables.content_groups_with_stats(unique, "text", "entity_group", config.near_duplicate_ratio, config.with_ratio)
    else:
        grouped = unique.withColumn("group_id", tables.group_name(F.col("text")))
        stats = tables.GroupStats(unique.count(), 0, 0, 0)
    folds = tables.fold_count(config.test_ratio, config.valid_ratio)
    dealt = tables.stratified_folds(grouped, folds, seed=config.seed)
    split = tables.split_name(F.col("fold"), config.test_ratio, config.valid_ratio)
    rows = dealt.select("text", "label", "kaynak", "group_id", split.alias("split"))
    rows = tables.stored(rows)
    tables.check_leakage(rows)
    return Cleaned(rows, rejected, conflicts, duplicates, file_reports(df), stats, config)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """df in a seeded order, the same for the same rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), *df.columns)


def split_profile(df: DataFrame) -> DataFrame:
    """For each split: rows, null, repeated and short texts (two words at most), sources and groups."""
    short = F.size(tokens(F.coalesce("text", F.lit("")))) <= 2
    text = F.coalesce("text", F.lit("\0"))
    return df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("text").isNull()).alias("null_texts"),
        (F.count("*") - F.count_distinct(text)).alias("duplicate_texts"),
        F.count_if(short).alias("short_messages"),
        F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"),
        F.count_distinct("kaynak").alias("sources"),
        F.count_distinct("group_id").alias("groups"),
    )


def audit(cleaned: Cleaned) -> dict:
    """The report of a cleaning run as plain values: one entry per file, split and source."""
    rows = cleaned.rows
    prints = {r["split"]: r["fingerprint"] for r in tables.fingerprint(rows, "text", "label", "kaynak", "group_id", by=("split",)).collect()}
    profile = {r["split"]: r.asDict() for r in split_profile(rows).collect()}
    sources = rows.groupBy("split", "kaynak").count().collect()
    files = [r.asDict() for r in cleaned.files.collect()]
    report = {
        "preprocessing_version": fixed.PREPROCESSING_VERSION,
        "seed": cleaned.config.seed,
        "input_files": files,
        "accepted_unique_rows": sum(p["rows"] for p in profile.values()),
        "exact_duplicate_rows": cleaned.duplicates.count(),
        "conflicting_texts": cleaned.conflicts.select("text").distinct().count(),
        **asdict(cleaned.stats),
        "splits": {s: {**p, "source_rows": {r["kaynak"]: r["count"] for r in sources if r["split"] == s}, "fingerprint": prints[s]} for s, p in profile.items()},
        "overlap": {c: {r["pair"]: r["shared"] for r in tables.overlaps(rows, c).collect()} for c in ("text", "group_id")},
        "data_version": tables.data_version([f["fingerprint"] for f in files]),
    }
    cleaned.audit = report
    return report
