"""Queries of users, appeals, model manifests and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.functions.rules import Lexicon
from winnow.functions.text import token_number
from winnow.operators import moderation, service
from winnow.plans.base import Query, read, workspace
from winnow.sources import sinks, splits
from winnow.streaming import state

QUERIES: dict[str, tuple[Query, str | None]] = {}


def _effects(s, d):
    lab = read(s, d, "labels")
    logs = lab.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("user_id"), (F.col("toxic") == 1).alias("is_toxic"), F.lit("warned").alias("action_taken"), F.lit("not_required").alias("review_status"), F.lit("threshold=0.8").alias("decision_reason"))
    users = logs.groupBy(F.col("user_id").alias("id")).agg(F.sum(F.col("is_toxic").cast("long")).alias("warning_count")).withColumn("is_banned", F.col("warning_count") >= 2)
    appeals = lab.filter("doc_id % 2 = 0").select((F.col("doc_id") + 1_000_000).alias("id"), F.col("doc_id").alias("message_id"), (F.col("doc_id") % 50).alias("user_id"), F.when(F.col("doc_id") % 6 == 0, "rejected").otherwise("open").alias("status"))
    decisions = lab.filter("doc_id % 4 = 0").select((F.col("doc_id") + 1_000_000).alias("appeal_id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), F.lit("seen").alias("note"))
    return service.appeal_effects(appeals, decisions, logs, users)


_EF = (
    "lg AS (SELECT doc_id AS id, doc_id % 50 AS user_id, toxic = 1 AS tox, doc_id % 2 = 0 AND doc_id % 6 <> 0 AS open, doc_id % 4 = 0 AS decided, quality = 1 AS yes FROM labels), "
    "ef AS (SELECT *, open AND decided AND yes AS acc FROM lg), us AS (SELECT user_id, count(*) FILTER (WHERE tox) AS w, count(*) FILTER (WHERE acc AND tox) AS back, bool_or(acc) AS freed FROM ef GROUP BY user_id)"
)
QUERIES["appeal_outcomes"] = (
    lambda s, d: _effects(s, d)[0].groupBy("status").agg(F.count("*").alias("n")),
    f"WITH {_EF} SELECT CASE WHEN NOT open THEN 'rejected' WHEN decided AND yes THEN 'accepted' WHEN decided THEN 'rejected' ELSE 'open' END AS status, count(*) AS n FROM ef WHERE id % 2 = 0 GROUP BY 1",
)
QUERIES["appeal_log_effects"] = (
    lambda s, d: _effects(s, d)[1].select("id", "is_toxic", "action_taken", "review_status", "decision_reason"),
    f"WITH {_EF} SELECT id, tox AND NOT acc AS is_toxic, CASE WHEN acc THEN 'passed' ELSE 'warned' END AS action_taken, CASE WHEN acc THEN 'overturned' ELSE 'not_required' END AS review_status, CASE WHEN acc THEN 'seen' ELSE 'threshold=0.8' END AS decision_reason FROM ef",
)
QUERIES["appeal_user_effects"] = (
    lambda s, d: _effects(s, d)[2].select("id", "warning_count", "is_banned"),
    f"WITH {_EF} SELECT user_id AS id, greatest(w - back, 0) AS warning_count, w >= 2 AND NOT freed AS is_banned FROM us",
)


def _users(s, d):
    return read(s, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), "doc_id").alias("username"), F.lit("user").alias("role"), F.col("quality").alias("warning_count"), (F.col("toxic") == 1).alias("is_banned"))


QUERIES["user_reset"] = (
    lambda s, d: service.reset_users(_users(s, d), _users(s, d).filter("id % 5 = 0").select(F.col("id").alias("user_id"))).select("id", "warning_count", "is_banned"),
    "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE quality END AS warning_count, toxic = 1 AND doc_id % 5 <> 0 AS is_banned FROM labels",
)
QUERIES["bootstrap_admin"] = (
    lambda s, d: moderation.bootstrap_admin(moderation.bootstrap_admin(_users(s, d), "U0"), "Root", "hash").select("id", "username", "role"),
    "SELECT doc_id AS id, 'u' || CAST(doc_id AS VARCHAR) AS username, CASE WHEN doc_id = 0 THEN 'admin' ELSE 'user' END AS role FROM labels "
    "UNION ALL SELECT (SELECT max(doc_id) FROM labels) + 1, 'u0', 'admin' WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = 0) "
    "UNION ALL SELECT (SELECT max(doc_id) FROM labels) + 1 + CASE WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = 0) THEN 0 ELSE 1 END, 'root', 'admin'",
)

_GOOD = {"model_version": "v1", "preprocessing_version": fixed.PREPROCESSING_VERSION, "threshold": 0.8, "label_mapping": {"0": "clean", "1": "toxic"}, "artifacts": {"model": "aa"}}
#: Manifests, digests of the artifacts that are there, and whether the model may serve.
_CASES = (
    ("good", _GOOD, {"model": "aa"}, True), ("missing", None, None, False), ("no_threshold", {k: v for k, v in _GOOD.items() if k != "threshold"}, None, False),
    ("other_forms", _GOOD | {"preprocessing_version": "0"}, None, False), ("low_threshold", _GOOD | {"threshold": 0.49}, None, False), ("odd_threshold", _GOOD | {"threshold": "x"}, None, False),
    ("labels", _GOOD | {"label_mapping": {"0": "a"}}, None, False), ("tampered", _GOOD, {"model": "ab"}, False), ("no_artifact", _GOOD, {}, False), ("edge", _GOOD | {"threshold": 0.999}, {"model": "aa"}, True),
)


def _gate(s, d):
    rows = []
    for name, manifest, digests, _ in _CASES:
        problem = moderation.model_problem(manifest, digests)
        status = moderation.health(problem, manifest, allow_rules_only=name != "tampered")
        rows.append((name, problem is None, status["mode"], status["status"], status["available"]))
    return s.createDataFrame(rows, "name string, accepted boolean, mode string, status string, available boolean")


QUERIES["model_gate"] = (
    _gate,
    "SELECT name, ok AS accepted, CASE WHEN ok THEN 'model' ELSE 'rules_only' END AS mode, CASE WHEN ok THEN 'online' ELSE 'degraded' END AS status, name <> 'tampered' AS available FROM (VALUES "
    + ", ".join(f"('{n}', {'true' if ok else 'false'})" for n, _, _, ok in _CASES) + ") t(name, ok)",
)


def _model_manifest(s, d):
    folder = workspace(s)
    sinks.write_model_manifest(s, f"{folder}/model.json", model_version="v2", threshold=0.75, artifacts={"labels": splits.folder_digest(s, f"{d}/labels.parquet")})
    kept = moderation.manifest_of(s, f"{folder}/model.json")
    digests = {"labels": splits.folder_digest(s, f"{d}/labels.parquet")}
    return s.createDataFrame([(kept["model_version"], kept["threshold"], moderation.model_problem(kept, digests) is None)], "model_version string, threshold double, accepted boolean")


QUERIES["model_manifest"] = (_model_manifest, "SELECT 'v2' AS model_version, CAST(0.75 AS DOUBLE) AS threshold, true AS accepted")


def _log_sink(s, d):
    folder = workspace(s)
    rows = read(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "pending").otherwise("not_required").alias("review_status"))
    for part in (0, 1):
        sinks.append_log(rows.filter(F.col("doc_id") % 2 == part), f"{folder}/log")
    return s.read.parquet(f"{folder}/log").groupBy("review_status").agg(F.count("*").alias("n"))


QUERIES["message_log_sink"] = (_log_sink, "SELECT CASE WHEN toxic = 1 THEN 'pending' ELSE 'not_required' END AS review_status, count(*) AS n FROM labels GROUP BY 1")
QUERIES["retention"] = (
    lambda s, d: state.unexpired(read(s, d, "events").withColumn("expires_at", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 5 DAYS"))), str(read(s, d, "events").agg(F.max("ts")).first()[0])).select("event_id"),
    "SELECT event_id FROM events WHERE event_id % 10 = 0 OR ts + INTERVAL 5 DAY >= (SELECT max(ts) FROM events)",
)
QUERIES["limiter_choice"] = (
    lambda s, d: s.createDataFrame([(u, moderation.limiter_kind(u)) for u in ("", "redis://store")], "url string, kind string"),
    "SELECT * FROM (VALUES ('', 'sliding_window'), ('redis://store', 'fixed_window')) t(url, kind)",
)
QUERIES["token_numbers"] = (lambda s, d: read(s, d, "documents").select(F.explode(F.array_distinct(F.split("text", " +"))).alias("word")).distinct().select("word", token_number(F.col("word")).alias("number")), None)

#: Events of each user in order; a recursive query takes the users' next events one by one.
_EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS t, lower(substr(event_type, 1, 1)) AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
_DAY = 86_400_000_000
QUERIES["sliding_window_limit"] = (
    lambda s, d: state.run_batch(read(s, d, "events"), state.limiter_step(3, 86400.0), value="event_type"),
    f"WITH RECURSIVE {_EV}, st(user_id, i, event_id, acc, ok) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), []::BIGINT[], false FROM ev UNION ALL "
    "SELECT user_id, i, event_id, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3 FROM "
    f"(SELECT e.user_id, e.i, e.event_id, e.t, list_filter(st.acc, lambda x: x >= e.t - {_DAY}) AS live FROM st JOIN ev e ON e.user_id = st.user_id AND e.i = st.i + 1)) "
    "SELECT user_id, event_id, ok AS result FROM st WHERE i > 0",
)
_LETTERS = Lexicon(terms=("cc", "vc", "pp"), contextual=(), phrases=())
QUERIES["message_buffer"] = (
    lambda s, d: state.run_batch(read(s, d, "events").withColumn("letter", F.substring("event_type", 1, 1)), state.buffer_step(_LETTERS, 86400.0), value="letter"),
    f"WITH RECURSIVE {_EV}, st(user_id, i, event_id, held, hit) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), []::STRUCT(l VARCHAR, t BIGINT)[], false FROM ev UNION ALL "
    "SELECT user_id, i, event_id, CASE WHEN spelt THEN [] ELSE nw END, spelt FROM (SELECT *, len(nw) >= 2 AND array_to_string(list_transform(nw, lambda x: x.l), '') IN ('cc', 'vc', 'pp') AS spelt FROM "
    f"(SELECT e.user_id, e.i, e.event_id, list_append(list_filter(st.held, lambda x: e.t - x.t < {_DAY}), {{'l': e.l, 't': e.t}})[-8:] AS nw FROM st JOIN ev e ON e.user_id = st.user_id AND e.i = st.i + 1))) "
    "SELECT user_id, event_id, hit AS result FROM st WHERE i > 0",
)
_VERDICT = "CASE WHEN event_id % 11 = 0 THEN 'toxic' WHEN event_id % 7 = 0 THEN 'review' WHEN event_id % 13 <> 0 THEN 'clean' END"
QUERIES["moderation_gate"] = (
    lambda s, d: state.moderation_gate(
        read(s, d, "events").withColumn("letter", F.substring("event_type", 1, 1)).withColumn("verdict", F.expr(_VERDICT)),
        state.gate_step(state.window_step(3, 864_000), state.buffer_step(_LETTERS, 864_000.0), 3), value=("letter", "verdict"),
    ),
    f"WITH RECURSIVE al AS (SELECT user_id, event_id, epoch_us(ts) AS t, lower(substr(event_type, 1, 1)) AS l, {_VERDICT} AS verdict, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 864000) ORDER BY ts, event_id) <= 3 AS ok FROM events), "
    "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM al WHERE ok), "
    "st(user_id, i, event_id, verdict, held, hit) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), []::STRUCT(l VARCHAR, t BIGINT)[], false FROM ev UNION ALL "
    "SELECT user_id, i, event_id, verdict, CASE WHEN spelt THEN [] ELSE nw END, spelt FROM (SELECT *, len(nw) >= 2 AND array_to_string(list_transform(nw, lambda x: x.l), '') IN ('cc', 'vc', 'pp') AS spelt FROM "
    f"(SELECT e.user_id, e.i, e.event_id, e.verdict, list_append(list_filter(st.held, lambda x: e.t - x.t < {10 * _DAY}), {{'l': e.l, 't': e.t}})[-8:] AS nw FROM st JOIN ev e ON e.user_id = st.user_id AND e.i = st.i + 1))), "
    "x AS (SELECT *, hit OR coalesce(verdict = 'toxic', false) AS bad FROM st WHERE i > 0), "
    "y AS (SELECT *, coalesce(sum(CAST(bad AS INTEGER)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM x) "
    "SELECT user_id, event_id, CASE WHEN prior >= 3 THEN 'forbidden' WHEN bad AND prior = 2 THEN 'banned' WHEN bad THEN 'warned' WHEN verdict = 'clean' THEN 'passed' ELSE 'queued_for_review' END AS result FROM y "
    "UNION ALL SELECT user_id, event_id, 'limited' AS result FROM al WHERE NOT ok",
)
