"""All queries of the engine by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from winnow.functions import fixed, rules, text
from winnow.operators import evaluate as ev
from winnow.operators import ml, profile, service, tables
from winnow.plans import accounts, corpus, texts
from winnow.plans.base import L, M, P, S, TEST_LEXICON, Query, labelled, labelled_sentences, messages, read, scores
from winnow.streaming import state

_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _ALL[name] = (query, sql)


def _every() -> dict[str, tuple[Query, str | None]]:
    return _ALL | texts.QUERIES | corpus.QUERIES | accounts.QUERIES


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _every().items() if s}


# --- profiling and relations: operators beside the SQL they stand for ---
_LAB = "(SELECT d.text, l.toxic AS label, d.source AS kaynak, d.doc_id AS satir_no FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _documents(s, d):
    return read(s, d, "documents")


def _labels(s, d):
    return read(s, d, "labels")


def _expired(s, d):
    events = read(s, d, "events")
    limit = events.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("_limit"))  # one row
    return service.expired(events.crossJoin(F.broadcast(limit)), F.col("_limit"), "ts").select("event_id")


def _source_counts(s, d):
    """Labelled documents, normalised, without conflicts and repeats, counted by source and label."""
    x = labelled(s, d).withColumn("text", text.for_model(F.col("text"), unicode_form=False))
    return profile.counts(tables.first_rows(tables.quarantine(x)), "kaynak", "label")


_add("source_label_counts", _source_counts,
     f"WITH n AS (SELECT {texts.model_sql('text')} AS t, label, kaynak, satir_no FROM {_LAB} x), k AS (SELECT t FROM n GROUP BY t HAVING count(DISTINCT label) > 1), u AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY label, kaynak, satir_no) AS p FROM n WHERE t NOT IN (SELECT t FROM k)) SELECT kaynak, label, count(*) AS n FROM u WHERE p = 1 GROUP BY ALL")
_add("class_counts", lambda s, d: profile.counts(labelled(s, d), "label"), f"SELECT label, count(*) AS n FROM {_LAB} x GROUP BY label")
_add("top_sources", lambda s, d: profile.largest(labelled(s, d), "kaynak", 15), f"SELECT kaynak, count(*) AS n FROM {_LAB} x GROUP BY kaynak ORDER BY n DESC, kaynak LIMIT 15")
_add("source_label_pivot", lambda s, d: profile.label_columns(labelled(s, d), "kaynak"), f"SELECT kaynak, count(*) FILTER (WHERE label = 0) AS clean, count(*) FILTER (WHERE label = 1) AS toxic FROM {_LAB} x GROUP BY kaynak")
_add("source_label_ratio", lambda s, d: profile.label_shares(labelled(s, d), "kaynak"), f"SELECT kaynak, round(avg(CAST(label AS DOUBLE)), 6) AS toxic_share, round(count(*) FILTER (WHERE label = 0) / count(*), 6) AS clean_share FROM {_LAB} x GROUP BY kaynak")
_add("null_profile", lambda s, d: profile.text_profile(_documents(s, d)), "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS null_texts, count(DISTINCT source) AS sources, count(*) FILTER (WHERE length(text) < 20) AS tiny FROM documents")
_add("duplicate_excess", lambda s, d: profile.excess_rows(_documents(s, d)), "SELECT count(*) - count(DISTINCT coalesce(text, '<null>')) AS excess FROM documents")
_add("schema_backfill", lambda s, d: service.backfilled(_documents(s, d).select("doc_id"), _labels(s, d), "doc_id", {"toxic": 0, "quality": -1}), "SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_add("unlabelled_documents", lambda s, d: service.missing(_documents(s, d), _labels(s, d), "doc_id", "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_add("point_lookup", lambda s, d: service.lookup(_documents(s, d), "doc_id", 42, "doc_id", "source", "lang"), "SELECT doc_id, source, lang FROM documents WHERE doc_id = 42")
_add("exists_check", lambda s, d: profile.counts(service.existing(read(s, d, "conversations"), _documents(s, d).filter("lang = 'en'"), "conv_id", "doc_id"), "conv_id"), "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY conv_id")
_add("fk_navigation", lambda s, d: _labels(s, d).filter("toxic = 1").join(_documents(s, d), "doc_id").select("doc_id", "source", "toxic", "quality"), "SELECT d.doc_id, d.source, l.toxic, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1")
_add("unique_constraint", lambda s, d: service.unique_violations(_documents(s, d), "source"), "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
_add("cascade_cleanup", lambda s, d: service.without_orphans(_labels(s, d), _documents(s, d).filter("lang <> 'de'"), "doc_id", "doc_id").select("doc_id", "toxic"), "SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
_add("review_queue", lambda s, d: service.queue(_labels(s, d), "quality = 0", F.desc("doc_id"), limit=50).select("doc_id", "quality"), "SELECT doc_id, quality FROM labels WHERE quality = 0 ORDER BY doc_id DESC LIMIT 50")
_add("open_appeals", lambda s, d: service.queue(_labels(s, d), "toxic = 1 AND quality = 0", F.asc("doc_id")).select("doc_id"), "SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0 ORDER BY doc_id")
_add("expired_rows", _expired, "SELECT event_id FROM events WHERE ts IS NOT NULL AND ts < (SELECT max(ts) - INTERVAL '10' DAY FROM events)")
_add("quality_summary", lambda s, d: profile.totals(rows=_documents(s, d), labelled=_labels(s, d), low_quality=_labels(s, d).filter("quality = 0"), toxic=_labels(s, d).filter("toxic = 1")), "SELECT 'rows' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(*) FROM labels UNION ALL SELECT 'low_quality', count(*) FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1")
_add("overlap_counts", lambda s, d: tables.overlaps(_documents(s, d).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "valid").otherwise("test")), "text"),
     "WITH x AS (SELECT DISTINCT text, ['train', 'valid', 'test'][doc_id % 3 + 1] AS split FROM documents WHERE text IS NOT NULL), pr(a, b) AS (VALUES ('train', 'valid'), ('train', 'test'), ('valid', 'test')) SELECT a || '-' || b AS pair, (SELECT count(*) FROM x p JOIN x q ON p.text = q.text WHERE p.split = a AND q.split = b) AS shared FROM pr")
_add("word_length_hist", lambda s, d: profile.histogram(labelled(s, d), profile.word_count(), 50, "label"),
     f"WITH {L}, x AS (SELECT label, len(list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '')) AS v FROM lab), q AS (SELECT quantile_cont(v, 0.99) AS hi, min(v) AS lo FROM x), b AS (SELECT label, CAST(least(floor((v - lo) / ((hi - lo) / 50.0)), 49) AS BIGINT) AS bin FROM x, q WHERE v <= hi) SELECT label, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM b GROUP BY label, bin")
_add("group_size_dist", lambda s, d: profile.group_sizes(labelled_sentences(s, d), "text"),
     f"WITH {S}, g AS (SELECT text, count(*) AS n FROM sent GROUP BY text), t AS (SELECT CAST(ceil(quantile_cont(n, 0.99)) AS BIGINT) AS top FROM g) SELECT least(n, top) AS size, n = 1 AS single, count(*) AS groups FROM g, t GROUP BY 1, 2")


def _load_lengths():
    return lambda texts: [len(t) % 100 / 100 for t in texts]


_add("plugged_scorer", lambda s, d: ml.score_with(_documents(s, d).select("doc_id", "text"), _load_lengths).select("doc_id", "p"), "SELECT doc_id, CAST(length(text) % 100 AS DOUBLE) / 100 AS p FROM documents")
_add("class_weights", lambda s, d: ev.class_weights(labelled(s, d)),
     f"WITH {L} SELECT label, round(least(greatest(CAST((SELECT count(*) FROM lab) AS DOUBLE) / (2.0 * count(*)), 0.25), 4.0), 6) AS weight FROM lab GROUP BY label")
_add("split_label_counts", lambda s, d: labelled(s, d).withColumn("split", tables.split_of(F.col("text"))).groupBy("split", "label").agg(F.count("*").alias("n")),
     f"WITH {L}, f AS (SELECT label, CAST(('0x' || substr(sha256('42:' || text), 1, 12)) AS BIGINT) % 20 AS fold FROM lab) SELECT CASE WHEN fold < 3 THEN 'test' WHEN fold < 5 THEN 'valid' ELSE 'train' END AS split, label, count(*) AS n FROM f GROUP BY ALL")
_add("fold_split", lambda s, d: labelled_sentences(s, d).select("text").distinct().select(F.sha2("text", 256).alias("h"), tables.split_of(F.col("text")).alias("split")),
     f"WITH {S}, f AS (SELECT DISTINCT text FROM sent), g AS (SELECT sha256(text) AS h, CAST(('0x' || substr(sha256('42:' || text), 1, 12)) AS BIGINT) % 20 AS fold FROM f) SELECT h, CASE WHEN fold < 3 THEN 'test' WHEN fold < 5 THEN 'valid' ELSE 'train' END AS split FROM g")
_add("strata_rare_merge", lambda s, d: tables.strata(labelled(s, d), 20).groupBy("stratum").agg(F.count("*").alias("n")),
     f"WITH {L}, c AS (SELECT label, kaynak, count(*) AS k FROM lab GROUP BY ALL), m AS (SELECT *, CASE WHEN k < 20 THEN CAST(label AS VARCHAR) || '|diger_kaynak' ELSE CAST(label AS VARCHAR) || '|' || kaynak END AS st FROM c), z AS (SELECT st, sum(k) AS n FROM m GROUP BY st), f AS (SELECT CASE WHEN (SELECT min(n) FROM z) < 20 THEN CAST(label AS VARCHAR) ELSE st END AS stratum, k FROM m) SELECT stratum, CAST(sum(k) AS BIGINT) AS n FROM f GROUP BY stratum")
_add("char_length_hist", lambda s, d: profile.histogram(labelled(s, d), F.length("text"), 60, "label"),
     f"WITH {L}, x AS (SELECT label, length(text) AS v FROM lab), q AS (SELECT quantile_cont(v, 0.99) AS hi, min(v) AS lo FROM x), b AS (SELECT label, CAST(least(floor((v - lo) / ((hi - lo) / 60.0)), 59) AS BIGINT) AS bin FROM x, q WHERE v <= hi) SELECT label, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM b GROUP BY label, bin")
_add("word_length_quantiles", lambda s, d: profile.quartiles(labelled(s, d), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")), "label"),
     f"WITH {L}, x AS (SELECT label, len(list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '')) AS w FROM lab) SELECT label, round(quantile_cont(w, 0.25), 6) AS q25, round(quantile_cont(w, 0.5), 6) AS q50, round(quantile_cont(w, 0.75), 6) AS q75, round(quantile_cont(w, 0.99), 6) AS q99, min(w) AS least, max(w) AS most FROM x GROUP BY label")


_WORDS = f"{L}, w AS (SELECT label, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM lab)"
_add("top_words", lambda s, d: tables.word_rows(labelled(s, d).withColumn("text", F.lower("text"))).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(30),
     f"WITH {_WORDS} SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 30")


def _per_class(k):
    def run(s, d):
        n = tables.word_rows(labelled(s, d).withColumn("text", F.lower("text")), "text", "label").groupBy("label", "word").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))
        return n.withColumn("place", place.cast("long")).filter(F.col("place") <= k)

    return run, f"WITH {_WORDS}, c AS (SELECT label, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL) SELECT * FROM (SELECT label, word, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS place FROM c) WHERE place <= {k}"


_add("top_words_per_class", *_per_class(25))
_add("word_cloud_frequencies", *_per_class(250))
_add("short_text_rate", lambda s, d: labelled_sentences(s, d).groupBy("kaynak").agg(F.round(F.avg((F.size(F.split("text", " +")) <= 2).cast("double")), 6).alias("share")),
     f"WITH {S} SELECT kaynak, round(avg(CAST(len(string_split_regex(text, ' +')) <= 2 AS DOUBLE)), 6) AS share FROM sent GROUP BY kaynak")
_add("word_stats", lambda s, d: labelled_sentences(s, d).withColumn("k", F.size(F.split("text", " +"))).groupBy("label").agg(F.count("*").alias("n"), F.sum("k").alias("words"), F.max("k").cast("long").alias("most")),
     f"WITH {S} SELECT label, count(*) AS n, CAST(sum(len(string_split_regex(text, ' +'))) AS BIGINT) AS words, max(len(string_split_regex(text, ' +'))) AS most FROM sent GROUP BY label")
_add("truncate_text", lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.truncated(F.col("text")), 256).alias("h")),
     "SELECT doc_id, sha256(CASE WHEN length(text) > 1500 THEN regexp_replace(substr(text, 1, 1500), ' [^ ]*$', '') ELSE text END) AS h FROM documents")

# --- labels and reasons ---
_LABEL_TEXTS = ("-1", "1,0", "1e0", "inf", "label_1", "not-toxic", "2", "Evet", " NO ", "hate", "off", "0.0", "maybe")


def _label_parse(s, d):
    n = len(_LABEL_TEXTS)
    raw = F.element_at(F.array(*[F.lit(x) for x in _LABEL_TEXTS]), (F.pmod(F.col("doc_id"), F.lit(n)) + 1).cast("int"))
    return read(s, d, "documents").select("doc_id", text.parse_label(raw).cast("int").alias("label"))


_add("label_parse", _label_parse,
     "WITH r AS (SELECT doc_id, list_extract([" + ", ".join(f"'{x}'" for x in _LABEL_TEXTS) + f"], CAST(doc_id % {len(_LABEL_TEXTS)} + 1 AS BIGINT)) AS raw FROM documents), n AS (SELECT doc_id, regexp_replace(lower(trim(raw)), '[_-]+', ' ', 'g') AS v FROM r), f AS (SELECT doc_id, v, CASE WHEN regexp_matches(trim(replace(v, ',', '.')), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?$') THEN try_cast(trim(replace(v, ',', '.')) AS DOUBLE) END AS x FROM n) SELECT doc_id, CAST(CASE WHEN x IS NOT NULL THEN CASE WHEN x = 1 THEN 1 WHEN x = 0 THEN 0 END WHEN v IN ("
     + ", ".join(f"'{x}'" for x in fixed.POSITIVE) + ") THEN 1 WHEN v IN (" + ", ".join(f"'{x}'" for x in fixed.NEGATIVE) + ") THEN 0 END AS INTEGER) AS label FROM f")
_add("reject_reasons", lambda s, d: _reasons(s, d).groupBy("reason").agg(F.count("*").alias("n")),
     "WITH x AS (SELECT CASE WHEN l.toxic IS NULL THEN 'invalid_label' WHEN coalesce(trim(d.text), '') = '' THEN 'empty_after_normalization' WHEN d.doc_id % 7 = 0 THEN 'annotator_disagreement' WHEN len(list_filter(string_split_regex(d.text, '\\s+'), lambda y: y <> '')) < 60 THEN 'too_short' ELSE 'accepted' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT reason, count(*) AS n FROM x GROUP BY reason")


def _reasons(s, d):
    x = read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left")
    agreement = F.when(F.pmod("doc_id", F.lit(7)) == 0, "No").otherwise("yes")
    return x.select("source", "toxic", F.coalesce(text.reject_reason(F.trim("text"), F.col("toxic"), agreement, 60), F.lit("accepted")).alias("reason"))


_add("file_report", lambda s, d: _reasons(s, d).groupBy("source").agg(F.count("*").alias("raw"), F.count_if(F.col("reason") == "accepted").alias("accepted"), F.count_if(F.col("reason") == "annotator_disagreement").alias("disagreement"), F.count_if(F.col("toxic").isNull()).alias("null_labels"), F.count_if(F.col("toxic") == 1).alias("positive")),
     "WITH x AS (SELECT d.source, l.toxic, CASE WHEN l.toxic IS NULL THEN 'i' WHEN coalesce(trim(d.text), '') = '' THEN 'e' WHEN d.doc_id % 7 = 0 THEN 'a' WHEN len(list_filter(string_split_regex(d.text, '\\s+'), lambda y: y <> '')) < 60 THEN 't' ELSE 'ok' END AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT source, count(*) AS raw, count(*) FILTER (WHERE r = 'ok') AS accepted, count(*) FILTER (WHERE r = 'a') AS disagreement, count(*) FILTER (WHERE toxic IS NULL) AS null_labels, count(*) FILTER (WHERE toxic = 1) AS positive FROM x GROUP BY source")



# --- conflicts and duplicates, over sentences ---
_add("conflict_texts", lambda s, d: tables.conflict_texts(labelled_sentences(s, d)), f"WITH {S} SELECT text FROM sent GROUP BY text HAVING count(DISTINCT label) > 1")
_add("conflict_quarantine", lambda s, d: tables.quarantine(labelled_sentences(s, d)).groupBy("kaynak", "label").agg(F.count("*").alias("n")),
     f"WITH {S} SELECT kaynak, label, count(*) AS n FROM sent WHERE text NOT IN (SELECT text FROM sent GROUP BY text HAVING count(DISTINCT label) > 1) GROUP BY kaynak, label")
_add("conflict_majority", lambda s, d: tables.majority(labelled_sentences(s, d)).groupBy("kaynak", "label").agg(F.count("*").alias("n")),
     f"WITH {S}, c AS (SELECT text, label, count(*) AS k FROM sent GROUP BY ALL), t AS (SELECT text, sum(k) AS a FROM c GROUP BY text) SELECT kaynak, label, count(*) AS n FROM sent JOIN c USING (text, label) JOIN t USING (text) WHERE 2 * k > a GROUP BY kaynak, label")
_add("duplicate_groups", lambda s, d: tables.duplicate_rows(labelled_sentences(s, d)).groupBy("text").agg(F.count("*").alias("n")), f"WITH {S} SELECT text, count(*) AS n FROM sent GROUP BY text HAVING count(*) > 1")
_add("dedupe_first", lambda s, d: tables.first_rows(labelled_sentences(s, d)).select("text", "label", "kaynak", "satir_no"),
     f"WITH {S} SELECT text, label, kaynak, satir_no FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY label, kaynak, dosya, satir_no) AS k FROM sent) WHERE k = 1")

# --- near duplicates ---
_W = f"{S}, t AS (SELECT DISTINCT text FROM sent), k AS (SELECT text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM t)"


def _texts(s, d):
    return labelled_sentences(s, d).select("text").distinct()


def _star(s, d, kind):
    k = tables.shared_keys(tables.stored(_texts(s, d))).filter(F.col("key").startswith(kind + ":"))
    f = k.groupBy("key").agg(F.min("text").alias("v"))
    return k.join(f, "key").filter("text > v").select(F.col("text").alias("u"), "v").distinct()


_add("ndg_compact_edges", lambda s, d: _star(s, d, "c"),
     f"WITH {_W}, c AS (SELECT text, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS key FROM t), g AS (SELECT key, min(text) AS v FROM c WHERE length(key) >= 4 GROUP BY key) SELECT DISTINCT text AS u, v FROM c JOIN g USING (key) WHERE text > v")
_add("ndg_bag_edges", lambda s, d: _star(s, d, "b"),
     f"WITH {_W}, c AS (SELECT text, array_to_string(list_sort(w), ' ') AS key FROM k WHERE len(w) BETWEEN 4 AND 40), g AS (SELECT key, min(text) AS v FROM c GROUP BY key) SELECT DISTINCT text AS u, v FROM c JOIN g USING (key) WHERE text > v")
_DEL = f"{_W}, dk AS (SELECT text, w, unnest(list_concat([array_to_string(w, ' ')], CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) ELSE [] END)) AS key FROM k WHERE len(w) BETWEEN 4 AND 14), g AS (SELECT key, min(text) AS v FROM dk GROUP BY key), pr AS (SELECT DISTINCT dk.text AS u, g.v, dk.w FROM dk JOIN g USING (key) WHERE dk.text > g.v)"
_add("ndg_deletion_candidates", lambda s, d: _star(s, d, "s"), f"WITH {_DEL} SELECT DISTINCT u, v FROM pr")


def _jaccard(s, d):
    e = _star(s, d, "s")
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"([{text.WORD}]+)"), 1))
    e = e.withColumn("j", F.size(F.array_intersect(w("u"), w("v"))) / F.size(F.array_union(w("u"), w("v"))))
    return e.filter("j >= 0.75").select("u", "v", F.round("j", 6).alias("j"))


_add("ndg_jaccard_edges", _jaccard,
     f"WITH {_DEL}, x AS (SELECT DISTINCT u, v, list_distinct(w) AS a, list_distinct(regexp_extract_all(lower(v), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM pr), y AS (SELECT u, v, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM x) SELECT DISTINCT u, v, round(j, 6) AS j FROM y WHERE j >= 0.75")
_add("ndg_ratio_edges", lambda s, d: tables.near_edges(_texts(s, d)))
_add("entity_groups", lambda s, d: messages(s, d).groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("grouped_rows")),
     f"WITH {M}, g AS (SELECT user_id, count(*) AS n FROM msg GROUP BY user_id) SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS grouped_rows FROM g")
_add("grouping_off", lambda s, d: _texts(s, d).select(tables.group_name(F.col("text")).alias("group_id")), f"WITH {S} SELECT DISTINCT 'g_' || substr(sha256(text), 1, 16) AS group_id FROM sent")

# --- evaluation ---
_C = "c AS (SELECT model, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn FROM sc GROUP BY model)"
_RATIOS = "coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(tn / nullif(tn + fp, 0), 0) AS sp"


def _s0(s, d):
    return scores(s, d).filter("model = 'm0'")


def _metrics(s, d):
    m = ev.metrics(ev.confusion(scores(s, d), 0.5, "model"))
    return m.select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "fpr", "fnr")])


_MET = f"WITH {P}, {_C}, r AS (SELECT *, {_RATIOS} FROM c), m AS (SELECT model, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((re + sp) / 2, 6) AS balanced_accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(fp / greatest(fp + tn, 1), 6) AS fpr, round(fn / greatest(fn + tp, 1), 6) AS fnr FROM r)"
_add("confusion", lambda s, d: ev.confusion(scores(s, d), 0.5, "model"), f"WITH {P}, {_C} SELECT * FROM c")
_add("metrics", _metrics, f"{_MET} SELECT * FROM m")
_add("model_comparison_unpivot", lambda s, d: _metrics(s, d).unpivot(["model"], ["accuracy", "f1", "mcc", "fpr"], "metric", "value"),
     f"{_MET} SELECT model, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT model, 'f1', f1 FROM m UNION ALL SELECT model, 'mcc', mcc FROM m UNION ALL SELECT model, 'fpr', fpr FROM m")
_add("best_model", lambda s, d: _metrics(s, d).agg(F.max_by("model", F.struct("f1", "model")).alias("model")), f"{_MET} SELECT model FROM m ORDER BY f1 DESC, model DESC LIMIT 1")
_add("per_class_metrics", lambda s, d: _per_class_metrics(s, d),
     f"WITH {P}, x AS (SELECT 1 AS class, p >= 0.5 AS hit, label = 1 AS own FROM s0 UNION ALL SELECT 0, p < 0.5, label = 0 FROM s0) SELECT class, count(*) FILTER (WHERE own) AS support, round(count(*) FILTER (WHERE hit AND own) / count(*) FILTER (WHERE hit), 6) AS precision, round(count(*) FILTER (WHERE hit AND own) / count(*) FILTER (WHERE own), 6) AS recall FROM x GROUP BY class")


def _per_class_metrics(s, d):
    x = _s0(s, d).select(F.explode(F.array(F.struct(F.lit(1).alias("class"), (F.col("p") >= 0.5).alias("hit"), (F.col("label") == 1).alias("own")), F.struct(F.lit(0).alias("class"), (F.col("p") < 0.5).alias("hit"), (F.col("label") == 0).alias("own")))).alias("x")).select("x.*")
    both = F.count_if(F.col("hit") & F.col("own"))
    return x.groupBy("class").agg(F.count_if("own").alias("support"), F.round(both / F.count_if("hit"), 6).alias("precision"), F.round(both / F.count_if("own"), 6).alias("recall"))


_CURVE = f"WITH {P}, a AS (SELECT p, sum(label) AS pos, count(*) AS n FROM s0 GROUP BY p), cv AS (SELECT p, pos, n, sum(pos) OVER d AS tp, sum(n - pos) OVER d AS fp, sum(pos) OVER () AS ap, sum(n - pos) OVER () AS an FROM a WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"
_add("roc_points", lambda s, d: ev.curve(_s0(s, d)).select("p", F.round(F.col("fp") / F.col("all_neg"), 6).alias("fpr"), F.round(F.col("tp") / F.col("all_pos"), 6).alias("tpr")), f"{_CURVE} SELECT p, round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr FROM cv")
_add("pr_points", lambda s, d: ev.curve(_s0(s, d)).select("p", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.col("all_pos"), 6).alias("recall")), f"{_CURVE} SELECT p, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall FROM cv")
_add("average_precision", lambda s, d: ev.average_precision(_s0(s, d)), f"{_CURVE} SELECT round(sum(pos / ap * tp / (tp + fp)), 6) AS average_precision FROM cv")
_add("roc_auc", lambda s, d: ev.roc_auc(_s0(s, d)), f"{_CURVE} SELECT round(CAST(sum((n - pos) * (tp - pos / 2.0)) AS DOUBLE) / max(ap * an), 6) AS roc_auc FROM cv")
_add("brier", lambda s, d: scores(s, d).groupBy("model").agg(F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 6).alias("brier")), f"WITH {P} SELECT model, round(avg((p - label) * (p - label)), 6) AS brier FROM sc GROUP BY model")
_add("ece15", lambda s, d: ev.ece(_s0(s, d)), f"WITH {P}, b AS (SELECT ceil(p * 15) AS bin, count(*) AS n, avg(p) AS c, avg(label) AS a FROM s0 WHERE p > 0 GROUP BY 1) SELECT round(sum(n * abs(c - a)) / (SELECT count(*) FROM s0), 6) AS ece FROM b")
_add("calibration10", lambda s, d: ev.calibration(_s0(s, d)),
     f"WITH {P}, b AS (SELECT p, label, " + " + ".join(f"CAST(p >= {e!r}::DOUBLE AS BIGINT)" for e in ev.numpy_edges(10)[1:-1]) + " AS bin FROM s0) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(label AS DOUBLE)), 6) AS share FROM b GROUP BY bin")
_add("temperature_fit", lambda s, d: ev.fit_temperature(_s0(s, d)).select(F.round("temperature", 6).alias("temperature")),
     f"WITH {P}, g AS (SELECT k, CAST(pow(10, log10(0.35) + k * (log10(4.0) - log10(0.35)) / 239) AS DOUBLE) AS t FROM range(240) r(k)), q AS (SELECT label, least(greatest(p, 0.000001), 0.999999)::DOUBLE AS p FROM s0), z AS (SELECT k, t, label, 1 / (1 + exp(-least(greatest(ln(p / (1 - p)) / t, -40), 40))) AS q FROM q, g), l AS (SELECT k, t, sum(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END) AS loss FROM z GROUP BY k, t) SELECT round(t, 6) AS temperature FROM l ORDER BY loss, k LIMIT 1")
_SWEEP = "CASE WHEN p >= t THEN 1 ELSE 0 END"
_add("threshold_sweep", lambda s, d: _sweep(s, d),
     f"WITH {P}, g AS (SELECT CAST(k AS DOUBLE) / 100 AS t FROM range(1, 100) r(k)), x AS (SELECT t, sum({_SWEEP} * label) AS tp, sum({_SWEEP} * (1 - label)) AS fp, sum(label) AS ap, sum(1 - label) AS an FROM s0, g GROUP BY t) SELECT round(t, 6) AS t, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / ap, 6) AS recall, round(fp / an, 6) AS fpr FROM x")


def _sweep(s, d):
    grid = s.range(1, 100).select((F.col("id").cast("double") / 100).alias("t"))
    c = _s0(s, d).groupBy("p").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    hit = F.col("p") >= F.col("t")
    x = c.crossJoin(F.broadcast(grid)).groupBy("t").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum("pos").alias("ap"), F.sum(F.col("n") - F.col("pos")).alias("an"))
    return x.select(F.round("t", 6).alias("t"), F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), 6).alias("precision"), F.round(F.col("tp") / F.col("ap"), 6).alias("recall"), F.round(F.col("fp") / F.col("an"), 6).alias("fpr"))


_add("focal_loss", lambda s, d: scores(s, d).groupBy("model").agg(F.round(F.avg(ev.focal_loss(F.col("p"), F.col("label"))), 6).alias("loss")),
     f"WITH {P}, x AS (SELECT model, CASE WHEN label = 1 THEN p ELSE 1 - p END AS pt FROM sc) SELECT model, round(avg((1 - pt) * (1 - pt) * -ln(greatest(pt, 1e-12))), 6) AS loss FROM x GROUP BY model")
_add("softmax_array", lambda s, d: read(s, d, "embeddings").select("vec_id", ev.softmax(F.slice(F.col("embedding").cast("array<double>"), 1, 4)).alias("q")).select("vec_id", *[F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(4)]),
     "WITH x AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(4)) + " FROM embeddings), y AS (SELECT *, greatest(e0, e1, e2, e3) AS m FROM x), z AS (SELECT vec_id, exp(e0 - m) AS a0, exp(e1 - m) AS a1, exp(e2 - m) AS a2, exp(e3 - m) AS a3 FROM y) SELECT vec_id, " + ", ".join(f"round(a{k} / (a0 + a1 + a2 + a3), 6) AS q{k}" for k in range(4)) + " FROM z")

# --- moderation ---
_HARD = ", ".join(f"'{t}'" for t in TEST_LEXICON.hard)
_TERMS = ", ".join(f"'{t}'" for t in TEST_LEXICON.terms)
_PUNCT = rules.PUNCTUATION.replace("'", "''")
_add("hard_term_hits", lambda s, d: messages(s, d).select("user_id", "seq", rules.hard_term(F.col("text"), TEST_LEXICON).alias("hit")),
     f"WITH {M} SELECT user_id, seq, len(list_intersect(string_split_regex(translate(lower(text), '{_PUNCT}', '{' ' * 32}'), '\\s+'), [{_HARD}])) > 0 AS hit FROM msg")
_add("leet_hits", lambda s, d: messages(s, d).select("user_id", "seq", rules.leet(F.col("text"), TEST_LEXICON).alias("hit")),
     f"WITH {M} SELECT user_id, seq, regexp_matches(text, '[@4\\^83€69#1!|05$§7+]') AND len(list_intersect(regexp_extract_all(translate(lower(text), '{fixed.RULE_LEET_FROM}', '{fixed.RULE_LEET_TO}'), '[a-zçğıöşü]+'), [{_TERMS}])) > 0 AS hit FROM (SELECT user_id, seq, translate(text, '{fixed.PLAIN_FROM}', '{fixed.PLAIN_TO}') AS text FROM msg)")
_add("phrase_hits", lambda s, d: messages(s, d).select("user_id", "seq", rules.phrase(F.col("text"), TEST_LEXICON).alias("hit")),
     f"WITH {M} SELECT user_id, seq, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])of\\s+the($|[^\\p{{L}}\\p{{N}}_])|(^|[^\\p{{L}}\\p{{N}}_])de\\s+la($|[^\\p{{L}}\\p{{N}}_])|der\\s*die') AS hit FROM msg")
_SPACED = "|".join("[^\\p{L}\\p{N}]+".join(t) for t in TEST_LEXICON.terms)
_add("spaced_hits", lambda s, d: messages(s, d).select("user_id", "seq", rules.spaced(F.col("text"), TEST_LEXICON).alias("hit")),
     f"WITH {M} SELECT user_id, seq, regexp_matches(translate(lower(text), '{fixed.PLAIN_FROM}', '{fixed.PLAIN_TO}'), '(^|[^\\p{{L}}\\p{{N}}_])({_SPACED})($|[^\\p{{L}}\\p{{N}}_])') AS hit FROM msg")
_add("category_severity", lambda s, d: messages(s, d).select("user_id", "seq", rules.category(F.col("text"), F.when(F.col("seq") == 0, "dictionary_evasion").otherwise("bert_calibrated")).alias("category")).withColumn("severity", rules.severity(F.col("category"))),
     f"WITH {M}, x AS (SELECT user_id, seq, CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in fixed.THREATS) + " THEN 'threat' WHEN seq = 0 THEN 'targeted_abuse' ELSE 'offensive_language' END AS category FROM msg) SELECT user_id, seq, category, CASE category WHEN 'threat' THEN 'critical' WHEN 'targeted_abuse' THEN 'high' ELSE 'medium' END AS severity FROM x")


def _decisions(s, d):
    parts = rules.decide(F.col("row_id") % 11 == 0, F.col("row_id") % 13 == 0, F.when(F.col("row_id") % 5 != 0, F.col("p")), 0.8)
    x = _s0(s, d).select("row_id", *[c.alias(k) for k, c in parts.items()])
    return x.select("row_id", "status", F.round("score", 4).alias("score"), "method", *[c.alias(k) for k, c in service.decision_matrix(F.col("status")).items()])


_add("decision_matrix", _decisions,
     f"WITH {P}, x AS (SELECT row_id, row_id % 11 = 0 AS r, row_id % 13 = 0 AS b, CASE WHEN row_id % 5 <> 0 THEN p END AS q FROM s0), y AS (SELECT row_id, CASE WHEN r OR b THEN 'toxic' WHEN q IS NULL THEN 'clean' WHEN q >= 0.8 THEN 'toxic' WHEN q >= 0.8::DOUBLE - 0.1::DOUBLE THEN 'review' ELSE 'clean' END AS status, round(CAST(CASE WHEN r THEN 0.99 WHEN b THEN 0.95 WHEN q IS NULL THEN 0 ELSE q END AS DOUBLE), 4) AS score, CASE WHEN r THEN 'dictionary_evasion' WHEN b THEN 'message_buffer' WHEN q IS NULL THEN 'rules_only_clean' ELSE 'bert_calibrated' END AS method FROM x) SELECT *, CASE status WHEN 'toxic' THEN 'warned' WHEN 'review' THEN 'queued_for_review' ELSE 'passed' END AS action, CASE WHEN status = 'review' THEN 'pending' ELSE 'not_required' END AS review_status, status = 'clean' AS shown FROM y")

# --- service ---
_add("warning_ban", lambda s, d: service.warn_and_ban(messages(s, d).select("user_id", "seq", (F.length("text") % 3 == 0).alias("is_toxic")), 2).select("user_id", "seq", "is_toxic", "warnings", "action"),
     f"WITH {M}, x AS (SELECT user_id, seq, length(text) % 3 = 0 AS is_toxic FROM msg), y AS (SELECT *, coalesce(sum(CAST(is_toxic AS INTEGER)) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM x) SELECT user_id, seq, is_toxic, CAST(prior + CAST(is_toxic AS INTEGER) AS BIGINT) AS warnings, CASE WHEN is_toxic AND prior + 1 >= 2 THEN 'banned' WHEN is_toxic THEN 'warned' ELSE 'passed' END AS action FROM y WHERE prior < 2")


def _review(s, d):
    lab = read(s, d, "labels")
    logs = lab.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("user_id"), (F.col("toxic") == 1).alias("is_toxic"), F.lit("queued_for_review").alias("action_taken"), F.lit("pending").alias("review_status"))
    users = logs.groupBy(F.col("user_id").alias("id")).agg(F.sum(F.col("is_toxic").cast("long")).alias("warning_count")).withColumn("is_banned", F.col("warning_count") >= 3)
    decisions = lab.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("message_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"))
    return service.decide_reviews(logs, decisions, users)


_LOG = "lg AS (SELECT doc_id AS id, doc_id % 50 AS user_id, toxic = 1 AS tox, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END END AS dec FROM labels)"
_add("review_transition", lambda s, d: _review(s, d)[0].groupBy("review_status", "action_taken", "is_toxic").agg(F.count("*").alias("n")),
     f"WITH {_LOG} SELECT CASE dec WHEN 'approved' THEN 'confirmed' WHEN 'rejected' THEN 'overturned' ELSE 'pending' END AS review_status, CASE WHEN dec = 'approved' AND NOT tox THEN 'warned' WHEN dec = 'rejected' THEN 'passed' ELSE 'queued_for_review' END AS action_taken, CASE dec WHEN 'approved' THEN true WHEN 'rejected' THEN false ELSE tox END AS is_toxic, count(*) AS n FROM lg GROUP BY ALL")
_add("review_user_effects", lambda s, d: _review(s, d)[1].select("id", "warning_count", "is_banned"),
     f"WITH {_LOG} SELECT user_id AS id, CAST(greatest(sum(CAST(tox AS INTEGER)) + sum(CASE WHEN dec = 'approved' AND NOT tox THEN 1 WHEN dec = 'rejected' AND tox THEN -1 ELSE 0 END), 0) AS BIGINT) AS warning_count, sum(CAST(tox AS INTEGER)) >= 3 AND NOT bool_or(coalesce(dec = 'rejected', false)) AS is_banned FROM lg GROUP BY user_id")


def _appeals(s, d):
    lab = read(s, d, "labels").filter("toxic = 1")
    a = lab.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("accepted").alias("status"))
    dec = lab.filter("doc_id % 4 <> 1").select(F.col("doc_id").alias("appeal_id"), F.when(F.col("quality") == 1, "rejected").otherwise("accepted").alias("decision"))
    return service.decide_appeals(a, dec)


_add("appeal_transition", _appeals,
     "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN quality = 1 THEN 'rejected' ELSE 'accepted' END ELSE 'accepted' END AS status FROM labels WHERE toxic = 1")
_add("appeal_create", lambda s, d: service.new_appeals(messages(s, d).select(F.col("user_id").alias("message_id"), (F.col("user_id") % 50).alias("user_id"), F.lit("why").alias("reason")), _review(s, d)[0], s.createDataFrame([(2, "open")], "message_id long, status string")).select("message_id"),
     f"WITH {_LOG} SELECT DISTINCT c.conv_id AS message_id FROM conversations c JOIN lg ON lg.id = c.conv_id WHERE NOT (coalesce(dec, '') = 'rejected') AND c.conv_id <> 2")
_add("aes_roundtrip", lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(service.decrypted(service.encrypted(F.col("text"), "k"), "k"), 256).alias("h"), service.decrypted(F.lit("bm8="), "k").alias("bad")),
     "SELECT doc_id, sha256(text) AS h, CAST(NULL AS VARCHAR) AS bad FROM documents")
_add("request_validation", lambda s, d: messages(s, d).select("user_id", "seq", service.request_problem(F.col("role"), F.when(F.col("seq") != 1, F.col("text")).otherwise("  ")).alias("problem")),
     f"WITH {M} SELECT user_id, seq, CASE WHEN NOT regexp_matches(lower(role), '^[a-z0-9_.-]{{3,64}}$') THEN 'username' WHEN seq = 1 OR trim(text) = '' THEN 'blank' WHEN length(text) > 4000 THEN 'too_long' END AS problem FROM msg")

# --- state ---
_add("fixed_window_limit", lambda s, d: state.fixed_window_limit(read(s, d, "events"), 3, 86400).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted")),
     "WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) <= 3 AS ok FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ok) AS accepted FROM x GROUP BY user_id")


_add("baseline_scorer", lambda s, d: ml.baseline_scores(labelled(s, d)).select("satir_no", "label", F.round("p", 6).alias("p")))
