"""Decisions, warnings, reviews and appeals as table transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def warn_and_ban(messages: DataFrame, threshold: int = 3) -> DataFrame:
    """messages (user_id, seq, is_toxic) with warnings, action and whether a ban came before.

    A banned user's messages are dropped before analysis.
    """
    before = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = messages.withColumn("prior", F.coalesce(F.sum(F.col("is_toxic").cast("long")).over(before), F.lit(0)))
    out = out.filter(F.col("prior") < threshold) if threshold > 0 else out
    warnings = F.col("prior") + F.col("is_toxic").cast("long")
    banned = F.lit(threshold > 0) & F.col("is_toxic") & (warnings >= threshold)
    action = F.when(banned, "banned").when(F.col("is_toxic"), "warned").otherwise("passed")
    return out.withColumn("warnings", warnings).withColumn("action", action).drop("prior")


def decision_matrix(status, score=None) -> dict[str, Column]:
    """Action, review status and whether the text is shown, from a decision's status."""
    return {
        "action": F.when(status == "toxic", "warned").when(status == "review", "queued_for_review").otherwise("passed"),
        "review_status": F.when(status == "review", "pending").otherwise("not_required"),
        "shown": status == "clean",
    }


def decide_reviews(logs: DataFrame, decisions: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New logs and users after review decisions (message_id, decision approved or rejected).

    Approved: confirmed; a message that was not toxic becomes toxic, warned, one warning more.
    Rejected: overturned; clean and passed, one warning less if it was toxic, and the ban ends.
    """
    joined = logs.join(decisions, logs["id"] == decisions["message_id"], "left").drop("message_id")
    yes, no = F.col("decision") == "approved", F.col("decision") == "rejected"
    change = F.when(yes & ~F.col("is_toxic"), 1).when(no & F.col("is_toxic"), -1).otherwise(0)
    per_user = joined.groupBy(F.col("user_id").alias("_u")).agg(F.sum(change).alias("_d"), F.max(F.when(no, 1).otherwise(0)).alias("_free"))
    new_users = users.join(per_user, users["id"] == F.col("_u"), "left").select(
        *[c for c in users.columns if c not in ("warning_count", "is_banned")],
        F.greatest(F.col("warning_count") + F.coalesce("_d", F.lit(0)), F.lit(0)).alias("warning_count"),
        (F.col("is_banned") & (F.coalesce("_free", F.lit(0)) == 0)).alias("is_banned"),
    )
    new_logs = joined.withColumns(
        {
            "action_taken": F.when(yes & ~F.col("is_toxic"), "warned").when(no, "passed").otherwise(F.col("action_taken")),
            "review_status": F.when(yes, "confirmed").when(no, "overturned").otherwise(F.col("review_status")),
            "is_toxic": F.when(yes, True).when(no, False).otherwise(F.col("is_toxic")),
        }
    ).drop("decision")
    return new_logs, new_users


def new_appeals(requests: DataFrame, logs: DataFrame, appeals: DataFrame) -> DataFrame:
    """Requests (message_id, user_id, reason) for own, not passed messages without an open appeal."""
    own = logs.filter("action_taken <> 'passed'").select(F.col("id").alias("message_id"), "user_id")
    open_ = appeals.filter("status = 'open'").select("message_id")
    return requests.join(own, ["message_id", "user_id"], "left_semi").join(open_, "message_id", "left_anti").dropDuplicates(["message_id"])


def decide_appeals(appeals: DataFrame, decisions: DataFrame) -> DataFrame:
    """appeals after decisions (appeal_id, decision, note); only open ones change."""
    joined = appeals.join(decisions, appeals["id"] == decisions["appeal_id"], "left").drop("appeal_id")
    hit = (F.col("status") == "open") & F.col("decision").isNotNull()
    return joined.withColumn("status", F.when(hit, F.col("decision")).otherwise(F.col("status"))).drop("decision")


def appeal_effects(appeals: DataFrame, decisions: DataFrame, logs: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New appeals, logs and users after decisions (appeal_id, decision accepted or rejected, note).

    Only open appeals (id, message_id, user_id, status) change.  An accepted one makes its message
    clean, passed and overturned, ends its user's ban, and takes back one warning for each message
    that was toxic, as long as there are any.
    """
    decided = decide_appeals(appeals, decisions)
    accepted = appeals.filter("status = 'open'").join(decisions.filter("decision = 'accepted'"), F.col("id") == F.col("appeal_id"))
    accepted = accepted.select("message_id", F.col("user_id").alias("_user"), F.col("note").alias("_note"))
    per_message = accepted.groupBy("message_id").agg(F.min("_note").alias("_note"), F.lit(True).alias("_hit"))
    joined = logs.join(per_message, logs["id"] == F.col("message_id"), "left").drop("message_id")
    hit = F.coalesce("_hit", F.lit(False))
    toxic = logs.filter("is_toxic").select(F.col("id").alias("_id"))
    back = accepted.select("_user", "message_id").distinct().join(toxic, F.col("message_id") == F.col("_id"), "left")
    back = back.groupBy("_user").agg(F.count("_id").alias("_back"))
    new_users = users.join(back, users["id"] == F.col("_user"), "left").select(
        *[c for c in users.columns if c not in ("warning_count", "is_banned")],
        F.greatest(F.col("warning_count") - F.coalesce("_back", F.lit(0)), F.lit(0)).alias("warning_count"),
        (F.col("is_banned") & F.col("_user").isNull()).alias("is_banned"),
    )
    changes = {"is_toxic": False, "action_taken": "passed", "review_status": "overturned"}
    new_logs = joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items() if c in logs.columns})
    if "decision_reason" in logs.columns:
        new_logs = new_logs.withColumn("decision_reason", F.when(hit, F.col("_note")).otherwise(F.col("decision_reason")))
    return decided, new_logs.drop("_hit", "_note"), new_users


def reset_users(users: DataFrame, named: DataFrame) -> DataFrame:
    """users without warnings and bans for the ids in named (user_id); an unknown id changes nothing."""
    own = named.select(F.col("user_id").alias("_u")).distinct()
    hit = F.col("_u").isNotNull()
    out = users.join(own, users["id"] == F.col("_u"), "left")
    return out.withColumns({"warning_count": F.when(hit, 0).otherwise(F.col("warning_count")), "is_banned": F.col("is_banned") & ~hit}).drop("_u")


def lookup(df: DataFrame, key: str, value, *columns: str) -> DataFrame:
    """The rows with one value of a unique key; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value)).select(*columns)


def queue(df: DataFrame, condition: Column | str, *order: Column, limit: int | None = None) -> DataFrame:
    """Rows of a state in an order, at most limit."""
    out = df.filter(condition).orderBy(*order)
    return out if limit is None else out.limit(limit)


def existing(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of df whose key occurs in other."""
    return df.join(other.select(F.col(other_key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of df whose key does not occur in other."""
    return df.join(other.select(F.col(other_key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Values of a key that should be unique and are not, with their rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def without_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows of child whose parent is still there."""
    return existing(child, parent, key, parent_key)


def backfilled(df: DataFrame, older: DataFrame, key: str, defaults: dict) -> DataFrame:
    """df with the columns of defaults from another table by key, and their default where it has no row or no value."""
    own = older.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in defaults])
    return df.join(own, F.col(key) == F.col("_key"), "left").select(*[F.col(c) for c in df.columns], *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def expired(df: DataFrame, now: Column, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) < now))


def encrypted(c, key: str):
    return F.base64(F.aes_encrypt(c, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")))


def decrypted(c, key: str):
    """Null for what this key did not encrypt."""
    return F.try_aes_decrypt(F.unbase64(c), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")).cast("string")


def request_problem(name, message):
    """Why a request is refused, or null."""
    return (
        F.when(name.isNull() | ~F.lower(name).rlike(r"^[a-z0-9_.-]{3,64}$"), "username")
        .when(message.isNull() | (F.trim(message) == ""), "blank")
        .when(F.length(message) > 4000, "too_long")
    )
