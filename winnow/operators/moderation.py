"""Moderation of messages as rows of a log, the gate of model manifests, and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import fixed, rules
from winnow.functions.text import hmac_sha256
from winnow.operators import service

LABELS = {"0": "clean", "1": "toxic"}
REQUIRED = ("model_version", "preprocessing_version", "threshold", "label_mapping", "artifacts")
HIDDEN, WAITING = "[hidden by moderation]", "[waiting for review]"


def displayed(text: Column, status: Column, hidden: str = HIDDEN, waiting: str = WAITING) -> Column:
    """What others see: the text only if it is clean."""
    return F.when(status == "toxic", hidden).when(status == "review", waiting).otherwise(text)


def log_rows(
    messages: DataFrame, lexicon: rules.Lexicon, *, threshold: float, key: str, model_version: str, retention_days: int, keep_text: bool = False, unicode_form: bool = True
) -> DataFrame:
    """Log rows of messages (user_id, seq, text, created_at, buffer_hit, score).

    A null score means rules only.  Texts are kept encrypted, and in clear only on request.
    """
    text = F.coalesce("text", F.lit(""))
    parts = rules.decide(rules.full_hit(text, lexicon, unicode_form), F.coalesce("buffer_hit", F.lit(False)), F.col("score"), threshold)
    out = messages.withColumns({k: parts[k] for k in ("status", "method")}).withColumn("toxicity_score", parts["score"])
    matrix = service.decision_matrix(F.col("status"))
    category = F.when(F.col("status") == "clean", "clean").otherwise(rules.category(text, F.col("method")))
    return out.select(
        "user_id", "seq",
        (text if keep_text else F.lit(None).cast("string")).alias("original_text"),
        service.encrypted(text, key).alias("encrypted_text"),
        hmac_sha256(text, key.encode()).alias("content_hash"),
        displayed(text, F.col("status")).alias("displayed_text"),
        (F.col("status") == "toxic").alias("is_toxic"),
        "toxicity_score", category.alias("category"), rules.severity(category).alias("severity"),
        F.col("method").alias("detection_method"), matrix["action"].alias("action_taken"), matrix["review_status"].alias("review_status"),
        F.lit(f"threshold={threshold}").alias("decision_reason"), F.lit(model_version).alias("model_version"),
        "created_at", (F.col("created_at") + F.make_interval(days=F.lit(retention_days))).alias("expires_at"),
    )


def model_problem(manifest: dict | None, digests: dict[str, str] | None = None) -> str | None:
    """Why a model may not serve, or None.  digests: SHA-256 of the artifacts that are there."""
    if manifest is None:
        return "no manifest"
    if missing := [k for k in REQUIRED if k not in manifest]:
        return f"manifest without {', '.join(missing)}"
    if manifest["preprocessing_version"] != fixed.PREPROCESSING_VERSION:
        return f"normal forms differ: model {manifest['preprocessing_version']}, code {fixed.PREPROCESSING_VERSION}"
    try:
        threshold = float(manifest["threshold"])
    except (TypeError, ValueError):
        return "threshold is no number"
    if not 0.5 <= threshold <= 0.999:
        return "threshold is not within 0.5 and 0.999"
    if manifest["label_mapping"] != LABELS:
        return "labels are not clean and toxic"
    if digests is not None:
        if not digests:
            return "no artifact"
        if wrong := sorted(k for k, v in digests.items() if manifest["artifacts"].get(k) != v):
            return f"artifacts differ: {', '.join(wrong)}"
    return None


def health(problem: str | None, manifest: dict | None = None, allow_rules_only: bool = True) -> dict:
    """Status of the service; available is False only where a model is a must and there is none."""
    usable = problem is None and manifest is not None
    return {
        "ready": usable,
        "mode": "model" if usable else "rules_only",
        "status": "online" if usable else "degraded",
        "available": usable or allow_rules_only,
        "reason": problem,
        "model_version": manifest["model_version"] if usable else "rules_only",
        "preprocessing_version": fixed.PREPROCESSING_VERSION,
        "threshold": float(manifest["threshold"]) if usable else None,
    }


def limiter_kind(store_url: str | None) -> str:
    """fixed_window where a shared store keeps counts, else sliding_window; see streaming.state."""
    return "fixed_window" if store_url else "sliding_window"


def bootstrap_admin(users: DataFrame, username: str | None, password_hash: str | None = None) -> DataFrame:
    """users with the named administrator: promoted if there, else added under the next id; no name changes nothing."""
    if not username:
        return users
    name = username.lower()
    promoted = users.withColumn("role", F.when(F.col("username") == name, "admin").otherwise(F.col("role")))
    last = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"), F.count_if(F.col("username") == name).alias("_there")).filter("_there = 0")
    values = {"id": (F.col("_last") + 1).cast(users.schema["id"].dataType), "username": F.lit(name), "password_hash": F.lit(password_hash), "role": F.lit("admin"), "warning_count": F.lit(0), "is_banned": F.lit(False)}
    fresh = last.select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in users.schema])
    return promoted.unionByName(fresh)


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    from winnow.sources.splits import read_json

    return read_json(spark, path)
