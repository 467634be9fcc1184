"""Queries of cleaning, groups, splits, sources and sinks of labelled rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.operators import cleaning, evaluate, increments, ml, sequence, tables
from winnow.plans.base import L, P, S, Query, labelled, labelled_sentences, read, scores, workspace
from winnow.sources import csv, embedded, sinks, splits

QUERIES: dict[str, tuple[Query, str | None]] = {}
_FOLDS = 20


# --- unified rows: documents with labels, some missing, some annotators in doubt ---
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    doubt = F.pmod("doc_id", F.lit(7)) == 0
    words = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    reason = F.when(F.col("toxic").isNull(), "invalid_label").when(F.trim("text") == "", "empty_after_normalization").when(doubt, "annotator_disagreement").when(words < 20, "too_short")
    kept = reason.isNull()
    text = F.trim("text")
    return x.select(
        F.col("text").alias("raw_text"), F.col("toxic").cast("string").alias("raw_label"),
        F.when(kept & (F.length(text) > 1500), F.regexp_replace(F.substring(text, 1, 1500), r" [^ ]*\z", "")).otherwise(text).alias("text"),
        F.col("toxic").cast("byte").alias("label"), F.col("source").alias("kaynak"), F.concat("lang", F.lit(".csv")).alias("dosya"), F.col("doc_id").alias("satir_no"),
        F.when(F.col("doc_id") % 11 == 0, F.concat("source", F.lit(":e"), (F.col("doc_id") % 33).cast("string"))).otherwise("").alias("entity_group"),
        reason.alias("red_nedeni"), doubt.alias("disagrees"), F.lower("text").contains("license").alias("placeholder"), (kept & (F.length(text) > 1500)).alias("was_truncated"),
    )


U = (
    "u0 AS (SELECT d.text AS raw_text, CAST(l.toxic AS VARCHAR) AS raw_label, trim(d.text) AS t, l.toxic AS label, d.source AS kaynak, d.lang || '.csv' AS dosya, d.doc_id AS satir_no, "
    "CASE WHEN d.doc_id % 11 = 0 THEN d.source || ':e' || CAST(d.doc_id % 33 AS VARCHAR) ELSE '' END AS entity_group, d.doc_id % 7 = 0 AS disagrees, contains(lower(d.text), 'license') AS placeholder, "
    "CASE WHEN l.toxic IS NULL THEN 'invalid_label' WHEN trim(d.text) = '' THEN 'empty_after_normalization' WHEN d.doc_id % 7 = 0 THEN 'annotator_disagreement' "
    "WHEN len(list_filter(string_split_regex(d.text, '\\s+'), lambda y: y <> '')) < 20 THEN 'too_short' END AS red_nedeni FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
    "u AS (SELECT *, CASE WHEN red_nedeni IS NULL AND length(t) > 1500 THEN regexp_replace(substr(t, 1, 1500), ' [^ ]*$', '') ELSE t END AS text, red_nedeni IS NULL AND length(t) > 1500 AS was_truncated FROM u0)"
)


def lanes_sql(columns: tuple[str, ...]) -> str:
    """The fingerprint of rows as an aggregate."""
    row = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' END || CAST(length(coalesce(CAST({c} AS VARCHAR), '')) AS VARCHAR) || ':' || coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    lanes = " || ',' || ".join(f"CAST(sum(CAST(('0x' || substr(sha256({row}), {1 + 15 * k}, 15)) AS BIGINT)::HUGEINT) AS VARCHAR)" for k in range(4))
    return f"sha256({lanes} || ',' || CAST(count(*) AS VARCHAR))"


QUERIES["accepted_and_rejected"] = (
    lambda s, d: (lambda a, r: a.select("dosya", F.lit("accepted").alias("part")).union(r.select("dosya", F.lit("rejected").alias("part"))))(*cleaning.divided(unified(s, d))).groupBy("dosya", "part").agg(F.count("*").alias("n")),
    f"WITH {U} SELECT dosya, CASE WHEN red_nedeni IS NULL THEN 'accepted' ELSE 'rejected' END AS part, count(*) AS n FROM u GROUP BY ALL",
)
QUERIES["file_reports"] = (
    lambda s, d: cleaning.file_reports(unified(s, d)).drop("raw_labels"),
    f"WITH {U} SELECT kaynak, dosya, count(*) AS raw_rows, count(*) FILTER (WHERE red_nedeni IS NULL) AS accepted_rows, count(*) FILTER (WHERE red_nedeni IS NOT NULL) AS rejected_rows, "
    "count(*) FILTER (WHERE disagrees) AS annotator_disagreement_rows, count(*) FILTER (WHERE placeholder) AS placeholder_annotation_rows, count(*) FILTER (WHERE was_truncated) AS truncated_rows, "
    "count(*) FILTER (WHERE red_nedeni IS NULL AND label = 0) AS label_0, count(*) FILTER (WHERE red_nedeni IS NULL AND label = 1) AS label_1, "
    f"{lanes_sql(('raw_text', 'raw_label'))} AS fingerprint FROM u GROUP BY kaynak, dosya",
)
QUERIES["raw_label_histogram"] = (
    lambda s, d: cleaning.file_reports(unified(s, d)).select("kaynak", "dosya", F.explode("raw_labels").alias("raw_label", "n")),
    f"WITH {U} SELECT kaynak, dosya, coalesce(raw_label, '<NULL>') AS raw_label, count(*) AS n FROM u GROUP BY ALL",
)


def _conflict_error(s, d):
    try:
        cleaning.resolved(labelled_sentences(s, d), "error")
    except cleaning.LabelConflict as stopped:
        return stopped.conflicts.groupBy("kaynak", "label").agg(F.count("*").alias("n"))
    raise AssertionError("the sentences have conflicts")


QUERIES["conflict_error"] = (
    _conflict_error,
    f"WITH {S} SELECT kaynak, label, count(*) AS n FROM sent WHERE text IN (SELECT text FROM sent GROUP BY text HAVING count(DISTINCT label) > 1) GROUP BY kaynak, label",
)
QUERIES["frame_fingerprint"] = (
    lambda s, d: tables.fingerprint(labelled_sentences(s, d), "text", "label", by=("kaynak",)),
    f"WITH {S} SELECT kaynak, {lanes_sql(('text', 'label'))} AS fingerprint FROM sent GROUP BY kaynak",
)
QUERIES["data_version"] = (
    lambda s, d: s.createDataFrame([(tables.data_version([r["fingerprint"] for r in tables.fingerprint(read(s, d, "documents"), "text", by=("source",)).collect()]),)], "version string"),
    f"WITH f AS (SELECT source, {lanes_sql(('text',))} AS h FROM documents GROUP BY source) SELECT 'combined-' || substr(sha256(string_agg(h, '' ORDER BY h) || '{fixed.PREPROCESSING_VERSION}'), 1, 12) AS version FROM f",
)

# --- groups: edges that need no sequence ratio, so that SQL can follow ---
_KEYS = (
    "tx AS (SELECT DISTINCT text, lower(text) AS low, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM base), "
    "ck AS (SELECT text, regexp_replace(low, '[^\\p{L}\\p{N}_]', '', 'g') AS key FROM tx), "
    "e1 AS (SELECT text AS u, min(text) OVER (PARTITION BY key) AS v FROM ck WHERE length(key) >= 4), "
    "bk AS (SELECT text, array_to_string(list_sort(w), ' ') AS key FROM tx WHERE len(w) BETWEEN 4 AND 40), "
    "e2 AS (SELECT text AS u, min(text) OVER (PARTITION BY key) AS v FROM bk), "
    "dk AS (SELECT text, w, unnest(list_concat([array_to_string(w, ' ')], CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) ELSE [] END)) AS key FROM tx WHERE len(w) BETWEEN 4 AND 14), "
    "dp AS (SELECT DISTINCT text AS u, w, min(text) OVER (PARTITION BY key) AS v FROM dk), "
    "e3 AS (SELECT u, v FROM (SELECT u, v, list_distinct(w) AS a, list_distinct(regexp_extract_all(lower(v), '[\\p{L}\\p{N}_]+')) AS b FROM dp WHERE u <> v) WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.9), "
    "ed AS (SELECT u, v FROM (SELECT * FROM e1 UNION SELECT * FROM e2 UNION SELECT * FROM e3) WHERE u <> v)"
)


def reach_sql(name: str, edges: str) -> str:
    """A recursive table name(node, root) of the least node that each node of edges(u, v) reaches."""
    return (
        f"{name}b AS (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}), "
        f"{name}r(node, seen) AS (SELECT u, u FROM {name}b UNION SELECT r.node, b.v FROM {name}r r JOIN {name}b b ON r.seen = b.u), "
        f"{name} AS (SELECT node, min(seen) AS root FROM {name}r GROUP BY node)"
    )


QUERIES["ndg_components"] = (
    lambda s, d: tables.content_groups(labelled_sentences(s, d).select("text").distinct(), with_ratio=False),
    f"WITH RECURSIVE {S}, base AS (SELECT DISTINCT text FROM sent), {_KEYS}, {reach_sql('cc', 'ed')} SELECT text, 'g_' || substr(sha256(coalesce(root, text)), 1, 16) AS group_id FROM base LEFT JOIN cc ON node = text",
)
QUERIES["ndg_components_ratio"] = (lambda s, d: tables.content_groups(labelled_sentences(s, d).select("text").distinct()), None)


def _sentences_with_entities(s, d):
    x = labelled_sentences(s, d)
    return x.groupBy("text").agg(F.min("satir_no").alias("satir_no")).withColumn("entity", F.when(F.col("satir_no") % 97 == 0, F.concat(F.lit("e"), F.col("satir_no").cast("string"))).otherwise(""))


def _group_stats(s, d):
    _, stats = tables.content_groups_with_stats(_sentences_with_entities(s, d), "text", "entity", with_ratio=False)
    return s.createDataFrame([(stats.groups, stats.near_duplicate_rows, stats.entity_groups, stats.entity_grouped_rows)], "groups long, near_duplicate_rows long, entity_groups long, entity_grouped_rows long")


_ENT = f"{S}, base AS (SELECT text, min(satir_no) AS satir_no, CASE WHEN min(satir_no) % 97 = 0 THEN 'e' || CAST(min(satir_no) AS VARCHAR) ELSE '' END AS entity FROM sent GROUP BY text), {_KEYS}"
QUERIES["near_duplicate_stats"] = (
    _group_stats,
    f"WITH RECURSIVE {_ENT}, {reach_sql('cc', 'ed')}, ee AS (SELECT node AS u, root AS v FROM cc UNION SELECT text, min(text) OVER (PARTITION BY entity) FROM base WHERE entity <> ''), {reach_sql('dd', 'ee')}, "
    "en AS (SELECT entity, count(*) AS n FROM base WHERE entity <> '' GROUP BY entity) "
    "SELECT (SELECT count(DISTINCT coalesce(root, text)) FROM base LEFT JOIN dd ON node = text) AS groups, (SELECT count(*) - count(DISTINCT coalesce(root, text)) FROM base LEFT JOIN cc ON node = text) AS near_duplicate_rows, "
    "(SELECT count(*) FROM en) AS entity_groups, CAST((SELECT sum(n - 1) FROM en) AS BIGINT) AS entity_grouped_rows",
)


# --- splits of whole groups, stratified ---
def _folded(s, d):
    rows = labelled(s, d).withColumn("group_id", F.concat(F.lit("g"), (F.col("satir_no") % 331).cast("string")))
    dealt = tables.stratified_folds(rows, _FOLDS, shard_groups=100)
    return dealt.withColumn("split", tables.split_name(F.col("fold")))


def _seed_sql(x: str) -> str:
    return f"CAST(('0x' || substr(sha256('42:' || {x}), 1, 12)) AS BIGINT)"


def folds_sql(rows: str, shard_groups: int) -> str:
    """Tables from rows(text, label, kaynak, group_id) to fd(..., stratum, fold, split)."""
    return (
        f"sc0 AS (SELECT label, kaynak, count(*) AS k FROM {rows} GROUP BY ALL), "
        f"sm AS (SELECT *, CASE WHEN k < {_FOLDS} THEN CAST(label AS VARCHAR) || '|diger_kaynak' ELSE CAST(label AS VARCHAR) || '|' || kaynak END AS st FROM sc0), "
        "sz AS (SELECT st, sum(k) AS n FROM sm GROUP BY st), "
        f"sf AS (SELECT label, kaynak, CASE WHEN (SELECT min(n) FROM sz) < {_FOLDS} THEN CAST(label AS VARCHAR) ELSE st END AS stratum FROM sm), "
        f"sr AS (SELECT r.*, sf.stratum FROM {rows} r JOIN sf USING (label, kaynak)), "
        "sg AS (SELECT group_id, stratum, count(*) AS n FROM sr GROUP BY ALL), "
        "gr AS (SELECT group_id, arg_max(stratum, (n, stratum)) AS s, CAST(sum(n) AS BIGINT) AS size FROM sg GROUP BY group_id), "
        f"gs AS (SELECT *, {_seed_sql('group_id')} AS o, CAST(floor(log2(size)) AS BIGINT) AS cl FROM gr), "
        f"gh AS (SELECT *, o % CAST(ceil((SELECT count(*) FROM gr) / {shard_groups}.0) AS BIGINT) AS sh FROM gs), "
        "gp AS (SELECT *, row_number() OVER (PARTITION BY s, cl, sh ORDER BY o, group_id) AS place, s || '|' || CAST(cl AS VARCHAR) || '|' || CAST(sh AS VARCHAR) AS cell FROM gh), "
        f"gf AS (SELECT group_id, (place + {_seed_sql('cell')}) % {_FOLDS} AS fold FROM gp), "
        "fd AS (SELECT sr.*, CAST(fold AS INTEGER) AS fold, CASE WHEN fold < 3 THEN 'test' WHEN fold < 5 THEN 'valid' ELSE 'train' END AS split FROM sr JOIN gf USING (group_id))"
    )


_FD = f"{L}, rw AS (SELECT text, label, kaynak, satir_no, 'g' || CAST(satir_no % 331 AS VARCHAR) AS group_id FROM lab), {folds_sql('rw', 100)}"
QUERIES["stratified_split"] = (
    lambda s, d: _folded(s, d).select("satir_no", "group_id", "stratum", "fold", "split"),
    f"WITH {_FD} SELECT satir_no, group_id, stratum, fold, split FROM fd",
)


def _overlap_counts(s, d):
    x = _folded(s, d)
    return tables.overlaps(x, "text").withColumn("what", F.lit("text")).union(tables.overlaps(x, "group_id").withColumn("what", F.lit("group")))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in tables.SPLIT_PAIRS)
QUERIES["leakage_check"] = (
    _overlap_counts,
    f"WITH {_FD}, pr(a, b) AS (VALUES {_PAIRS}), "
    "tt AS (SELECT DISTINCT text AS x, split FROM fd), gg AS (SELECT DISTINCT group_id AS x, split FROM fd) "
    "SELECT a || '-' || b AS pair, (SELECT count(*) FROM tt p JOIN tt q ON p.x = q.x WHERE p.split = a AND q.split = b) AS shared, 'text' AS what FROM pr "
    "UNION ALL SELECT a || '-' || b, (SELECT count(*) FROM gg p JOIN gg q ON p.x = q.x WHERE p.split = a AND q.split = b), 'group' FROM pr",
)
QUERIES["split_profile"] = (
    lambda s, d: cleaning.split_profile(_folded(s, d)),
    f"WITH {_FD} SELECT split, count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS null_texts, count(*) - count(DISTINCT text) AS duplicate_texts, "
    "count(*) FILTER (WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '')) <= 2) AS short_messages, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1, "
    "count(DISTINCT kaynak) AS sources, count(DISTINCT group_id) AS groups FROM fd GROUP BY split",
)
_CONFIG = cleaning.CleaningConfig(group_near_duplicates=False)
_CLEAN = (
    f"{U}, ac AS (SELECT * FROM u WHERE red_nedeni IS NULL), cf AS (SELECT text FROM ac GROUP BY text HAVING count(DISTINCT label) > 1), "
    "un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY label, kaynak, dosya, satir_no) AS k FROM ac WHERE text NOT IN (SELECT text FROM cf)) WHERE k = 1), "
    f"rw AS (SELECT text, label, kaynak, 'g_' || substr(sha256(text), 1, 16) AS group_id FROM un), {folds_sql('rw', 10_000)}"
)
QUERIES["cleaning_run"] = (
    lambda s, d: cleaning.clean(unified(s, d), _CONFIG).rows.groupBy("split", F.col("label").cast("int").alias("label"), "kaynak").agg(F.count("*").alias("n")),
    f"WITH {_CLEAN} SELECT split, label, kaynak, count(*) AS n FROM fd GROUP BY ALL",
)


def _written(s, d, config=_CONFIG):
    folder = workspace(s)
    sinks.write_cleaned(cleaning.clean(unified(s, d), config), f"{folder}/out", f"{folder}/reports")
    return folder


# the same with groups of near duplicates and of entities, by keys that need no sequence ratio
_GROUPED = cleaning.CleaningConfig(with_ratio=False)
_UNIQUE = _CLEAN[: _CLEAN.index(", rw AS")]
_CLEAN_GROUPED = (
    f"{_UNIQUE}, base AS (SELECT text, entity_group AS entity FROM un), {_KEYS}, {reach_sql('cc', 'ed')}, "
    f"ee AS (SELECT node AS u, root AS v FROM cc UNION SELECT text, min(text) OVER (PARTITION BY entity) FROM base WHERE entity <> ''), {reach_sql('dd', 'ee')}, "
    f"rw AS (SELECT text, label, kaynak, 'g_' || substr(sha256(coalesce(root, text)), 1, 16) AS group_id FROM un LEFT JOIN dd ON node = text), {folds_sql('rw', 10_000)}"
)
QUERIES["cleaning_run_grouped"] = (
    lambda s, d: cleaning.clean(unified(s, d), _GROUPED).rows.groupBy("split", F.col("label").cast("int").alias("label"), "kaynak").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups")),
    f"WITH RECURSIVE {_CLEAN_GROUPED} SELECT split, label, kaynak, count(*) AS n, count(DISTINCT group_id) AS groups FROM fd GROUP BY ALL",
)


QUERIES["splits_round_trip"] = (
    lambda s, d: splits.read_training_splits(s, f"{_written(s, d)}/out").select("split", F.sha2("text", 256).alias("h"), F.col("label").cast("int").alias("label"), "kaynak", "group_id"),
    f"WITH {_CLEAN} SELECT split, sha256(text) AS h, label, kaynak, group_id FROM fd",
)


def _manifest(s, d):
    m = splits.read_json(s, f"{_written(s, d)}/out/{splits.MANIFEST}")
    return s.createDataFrame([(k, v, m["data_version"], m["preprocessing_version"]) for k, v in m["split_fingerprints"].items()], "split string, fingerprint string, data_version string, preprocessing_version string")


QUERIES["split_manifest"] = (
    _manifest,
    f"WITH {_CLEAN}, ff AS (SELECT {lanes_sql(('raw_text', 'raw_label'))} AS h FROM u GROUP BY kaynak, dosya), dv AS (SELECT 'combined-' || substr(sha256(string_agg(h, '' ORDER BY h) || '{fixed.PREPROCESSING_VERSION}'), 1, 12) AS v FROM ff) "
    f"SELECT split, {lanes_sql(('text', 'label', 'kaynak', 'group_id'))} AS fingerprint, any_value((SELECT v FROM dv)) AS data_version, '{fixed.PREPROCESSING_VERSION}' AS preprocessing_version FROM fd GROUP BY split",
)


def _audit(s, d, config=_CONFIG):
    report = splits.read_json(s, f"{_written(s, d, config)}/reports/data_audit.json")
    names = ("accepted_unique_rows", "exact_duplicate_rows", "conflicting_texts", "groups", "near_duplicate_rows", "entity_groups", "entity_grouped_rows")
    return s.createDataFrame([(n, report[n]) for n in names], "metric string, n long")


QUERIES["audit_report"] = (
    _audit,
    f"WITH {_CLEAN}, lf AS (SELECT * FROM ac WHERE text NOT IN (SELECT text FROM cf)) SELECT 'accepted_unique_rows' AS metric, count(*) AS n FROM fd UNION ALL "
    "SELECT 'exact_duplicate_rows', count(*) FROM lf WHERE text IN (SELECT text FROM lf GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'conflicting_texts', count(*) FROM cf UNION ALL "
    "SELECT 'groups', count(*) FROM fd UNION ALL SELECT 'near_duplicate_rows', 0 UNION ALL SELECT 'entity_groups', 0 UNION ALL SELECT 'entity_grouped_rows', 0",
)


QUERIES["audit_report_grouped"] = (
    lambda s, d: _audit(s, d, _GROUPED),
    f"WITH RECURSIVE {_CLEAN_GROUPED}, lf AS (SELECT * FROM ac WHERE text NOT IN (SELECT text FROM cf)), en AS (SELECT entity, count(*) AS n FROM base WHERE entity <> '' GROUP BY entity) "
    "SELECT 'accepted_unique_rows' AS metric, count(*) AS n FROM fd UNION ALL "
    "SELECT 'exact_duplicate_rows', count(*) FROM lf WHERE text IN (SELECT text FROM lf GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'conflicting_texts', count(*) FROM cf UNION ALL "
    "SELECT 'groups', count(DISTINCT group_id) FROM fd UNION ALL SELECT 'near_duplicate_rows', (SELECT count(*) - count(DISTINCT coalesce(root, text)) FROM base LEFT JOIN cc ON node = text) UNION ALL "
    "SELECT 'entity_groups', (SELECT count(*) FROM en) UNION ALL SELECT 'entity_grouped_rows', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM en)",
)


# --- balanced folds of content groups; groups of batches; bounds of the sequence ratio ---
def _balanced(s, d):
    rows = tables.content_groups(tables.first_rows(labelled_sentences(s, d)), with_ratio=False)
    dealt = tables.settled(tables.balanced_folds(rows, _FOLDS).select("text", "label", "group_id", "fold"))
    crossing = dealt.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") != 1).alias("crossing"))
    each = dealt.groupBy("label", "fold").count().groupBy("label").agg(F.sum("count").alias("rows"), F.count("fold").alias("folds"), F.max("count").alias("most"), F.min("count").alias("least"))
    even = (F.col("most") / F.col("rows") - 1 / _FOLDS <= 0.01) & (F.lit(1 / _FOLDS) - F.col("least") / F.col("rows") <= 0.01)
    groups = dealt.groupBy("label").agg(F.count_distinct("group_id").alias("groups"))
    return each.join(groups, "label").join(crossing).select("label", "rows", "groups", "folds", even.alias("even"), "crossing")  # crossing: one row


QUERIES["balanced_split"] = (
    _balanced,
    f"WITH RECURSIVE {S}, un AS (SELECT text, arg_min(label, (label, kaynak, dosya, satir_no)) AS label FROM sent GROUP BY text), base AS (SELECT text FROM un), {_KEYS}, {reach_sql('cc', 'ed')} "
    f"SELECT label, count(*) AS rows, count(DISTINCT coalesce(root, text)) AS groups, {_FOLDS}::BIGINT AS folds, true AS even, 0::BIGINT AS crossing FROM un LEFT JOIN cc ON node = text GROUP BY label",
)


def _batched(s, d):
    texts = tables.stored(labelled_sentences(s, d).select("text").distinct())
    state = increments.Groups(s, f"{workspace(s)}/groups", with_ratio=False)
    for k in range(3):
        state.add(texts.filter(F.length("text") % 3 == k))
    return state.groups()


QUERIES["ndg_batches"] = (_batched, QUERIES["ndg_components"][1])


def _ratio_bounds(s, d):
    pairs = tables.ratio_pairs(tables.shared_keys(tables.stored(labelled_sentences(s, d).select("text").distinct())))
    told = pairs.select("u", "v", F.round(sequence.length_bound(F.col("v"), F.col("u")), 6).alias("by_length"), F.round(sequence.character_bound(F.col("v"), F.col("u")), 6).alias("by_characters"))
    return told


QUERIES["ratio_bounds"] = (
    _ratio_bounds,
    f"WITH {S}, base AS (SELECT DISTINCT text FROM sent), {_KEYS}, "
    "pr AS (SELECT DISTINCT u, v FROM (SELECT u, v, list_distinct(w) AS a, list_distinct(regexp_extract_all(lower(v), '[\\p{L}\\p{N}_]+')) AS b FROM dp WHERE u <> v) WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) < 0.9), "
    "ch AS (SELECT u, v, string_split(u, '') AS x, string_split(v, '') AS y FROM pr) "
    "SELECT u, v, round(2.0::DOUBLE * least(len(x), len(y)) / (len(x) + len(y)), 6) AS by_length, "
    "round(2.0::DOUBLE * list_sum(list_transform(list_distinct(x), lambda c: least(len(list_filter(x, lambda z: z = c)), len(list_filter(y, lambda z: z = c))))) / (len(x) + len(y)), 6) AS by_characters FROM ch",
)


def _quality_tables(s, d):
    folder = f"{_written(s, d)}/reports/"
    rejected = splits._table(s, f"{folder}rejected_rows.csv", "csv")
    return rejected.groupBy("red_nedeni", "dosya").agg(F.count("*").alias("n"))


QUERIES["quality_tables"] = (_quality_tables, f"WITH {U} SELECT red_nedeni, dosya, count(*) AS n FROM u WHERE red_nedeni IS NOT NULL GROUP BY ALL")


def _csv_sources(s, d):
    base = workspace(s)
    x = labelled(s, d).filter("length(trim(text)) > 0").withColumn("k", F.pmod("satir_no", F.lit(4)))
    x.write.partitionBy("k").option("compression", "zstd").parquet(f"{base}/rows")
    named = {"train-2.csv": 0, "Turkish Toxic.csv": 1, "Ham Veri/test.csv": 2, "Diğer Notlar.csv": 3}
    schema = x.drop("k").schema
    for name, k in named.items():
        try:
            own = s.read.schema(schema).parquet(f"{base}/rows/k={k}")
        except AnalysisException:  # no row has this remainder
            own = s.createDataFrame([], schema)
        # a folder of part files, each a range of rows in their order
        own = own.orderBy("satir_no")
        if k % 2:
            own = own.select(F.when(F.col("label") == 1, "hate").otherwise("clean").alias("Label"), F.concat(F.lit("u"), (F.col("satir_no") % 9).cast("string")).alias("User ID"), "text")
        else:
            own = own.select(F.col("text").alias("Metin"), F.col("label").alias("etiket"), F.lit("yes").alias("agreement"))
        sinks.write_table(own, f"{base}/raw/{name}")
    out = csv.load(s, f"{base}/raw")
    chars = F.sum(F.length("raw_text")).alias("chars")
    return out.groupBy("kaynak", "dosya", F.col("label").cast("int").alias("label"), F.when(F.col("entity_group") == "", "none").otherwise("some").alias("entity")).agg(
        F.count("*").alias("n"), F.count_distinct("entity_group").alias("entities"), F.sum("satir_no").alias("line_numbers"), chars)


QUERIES["csv_sources"] = (
    _csv_sources,
    f"""WITH {L}, numbered AS (SELECT *, satir_no % 4 AS k, row_number() OVER (PARTITION BY satir_no % 4 ORDER BY satir_no) + 1 AS line FROM lab WHERE length(trim(text)) > 0)
    SELECT ['uploaded_2', 'huggingface', 'kaggle', 'diger_notlar'][k + 1] AS kaynak, ['train-2.csv', 'Turkish Toxic.csv', 'test.csv', 'Diğer Notlar.csv'][k + 1] AS dosya, label,
    CASE WHEN k % 2 = 0 THEN 'none' ELSE 'some' END AS entity, count(*) AS n, count(DISTINCT CASE WHEN k % 2 = 0 THEN -1 ELSE satir_no % 9 END) AS entities,
    sum(line)::BIGINT AS line_numbers, sum(length(text))::BIGINT AS chars FROM numbered GROUP BY ALL""",
)


def _jdbc(s, d):
    return embedded.round_trip(read(s, d, "labels").select("doc_id", "toxic", "quality"), workspace(s))


QUERIES["jdbc_round_trip"] = (_jdbc, "SELECT doc_id, toxic, quality FROM labels")
QUERIES["file_digests"] = (lambda s, d: splits.file_digests(s, d, "labels.parquet").selectExpr("length(sha256) AS digits").agg(F.count("*").alias("files"), F.max("digits").alias("digits")), "SELECT CAST(1 AS BIGINT) AS files, 64 AS digits")

# --- evaluation and training ---
_S0 = f"WITH {P}"


def _s0(s, d):
    return scores(s, d).filter("model = 'm0'")


QUERIES["temperature_apply"] = (
    lambda s, d: scores(s, d).select("model", "row_id", F.round(evaluate.tempered(F.col("p"), 2.5), 6).alias("p")),
    f"{_S0} SELECT model, row_id, round(1 / (1 + exp(-least(greatest(ln(q / (1 - q)) / 2.5::DOUBLE, -40), 40))), 6) AS p FROM (SELECT model, row_id, least(greatest(p, 0.000001::DOUBLE), 1::DOUBLE - 0.000001::DOUBLE) AS q FROM sc)",
)
QUERIES["temperature_single_class"] = (lambda s, d: evaluate.fit_temperature(_s0(s, d).filter("label = 1")), f"{_S0} SELECT CASE WHEN count(DISTINCT label) = 1 THEN CAST(1 AS DOUBLE) END AS temperature FROM s0 WHERE label = 1")
QUERIES["probability_histogram"] = (
    lambda s, d: evaluate.probability_histogram(_s0(s, d)),
    f"{_S0} SELECT label, CAST(least(floor(p * 50), 49) AS BIGINT) AS bin, count(*) AS n, round(count(*) * 50 / sum(count(*)) OVER (PARTITION BY label), 6) AS density FROM s0 GROUP BY 1, 2",
)
QUERIES["confusion_normalized"] = (
    lambda s, d: evaluate.confusion_shares(scores(s, d), 0.5, "model"),
    f"{_S0} SELECT model, " + ", ".join(f"round(count(*) FILTER (WHERE label = {lab} AND p {op} 0.5) / count(*) FILTER (WHERE label = {lab}), 6) AS {n}" for n, lab, op in (("tn", 0, "<"), ("fp", 0, ">="), ("fn", 1, "<"), ("tp", 1, ">="))) + " FROM sc GROUP BY model",
)
_EVEN = "SELECT 0.5::DOUBLE + k * 0.499::DOUBLE / 749 AS t FROM range(750) r(k)"
QUERIES["threshold_select"] = (
    lambda s, d: evaluate.select_threshold(_s0(s, d), 0.35).select(F.round("threshold", 6).alias("threshold")),
    f"{_S0}, gq AS (SELECT unnest(quantile_cont(p, [" + ", ".join(f"{k / 249!r}" for k in range(250)) + f"])) AS t FROM s0), g AS (SELECT DISTINCT t FROM (SELECT t FROM gq UNION ALL {_EVEN}) WHERE t BETWEEN 0.5 AND 0.999), "
    "c AS (SELECT t, sum(CASE WHEN p >= t AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= t AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < t AND label = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN p < t AND label = 1 THEN 1 ELSE 0 END) AS fn FROM s0, g GROUP BY t), "
    "m AS (SELECT t, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, fp / greatest(fp + tn, 1) AS fpr FROM c) "
    "SELECT round(coalesce((SELECT t FROM m WHERE fpr <= 0.35 ORDER BY coalesce(2 * pr * re / nullif(pr + re, 0), 0) DESC, re DESC, pr DESC, t LIMIT 1), 0.999), 6) AS threshold",
)


def _history(s, d):
    x = _s0(s, d).groupBy((F.col("row_id") % 5).cast("int").alias("epoch")).agg(F.round(F.avg("p"), 6).alias("loss"), F.round(F.avg(F.when(F.col("row_id") % 5 != 3, F.col("label").cast("double"))), 6).alias("accuracy"))
    folder = workspace(s)
    sinks.write_history(x, folder, "m0")
    back = s.read.csv(f"{folder}/history_m0.csv", header=True, schema="epoch int, loss double, accuracy double")
    return evaluate.history_curves(back, "loss", "accuracy")


QUERIES["history_curves"] = (
    _history,
    f"{_S0}, e AS (SELECT CAST(row_id % 5 AS INTEGER) AS epoch, round(avg(p), 6) AS loss, round(avg(CASE WHEN row_id % 5 <> 3 THEN CAST(label AS DOUBLE) END), 6) AS accuracy FROM s0 GROUP BY 1) SELECT epoch, 'loss' AS metric, loss AS value FROM e UNION ALL SELECT epoch, 'accuracy', accuracy FROM e WHERE accuracy IS NOT NULL",
)


def _metric_files(s, d):
    m = evaluate.metrics(evaluate.confusion(scores(s, d), 0.5, "model"))
    m = m.select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "fpr")])
    folder = workspace(s)
    sinks.write_metrics(m, folder, ("accuracy", "recall", "fpr"))
    kept = splits.read_json(s, f"{folder}/model_metrics.json")
    return s.createDataFrame([(k, *[v[c] for c in ("accuracy", "recall", "fpr")]) for k, v in kept.items()], "model string, accuracy double, recall double, fpr double")


QUERIES["metric_files"] = (
    _metric_files,
    f"{_S0} SELECT model, round(avg(CAST((p >= 0.5) = (label = 1) AS DOUBLE)), 6) AS accuracy, round(count(*) FILTER (WHERE p >= 0.5 AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS recall, round(count(*) FILTER (WHERE p >= 0.5 AND label = 0) / count(*) FILTER (WHERE label = 0), 6) AS fpr FROM sc GROUP BY model",
)


def _vector_ids(s, d):
    x = labelled(s, d)
    out = ml.vectorised(x, ml.vocabulary(x, min_count=5, most=500), length=12)
    return out.select("satir_no", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


QUERIES["vector_ids"] = (
    _vector_ids,
    f"WITH {L}, tk AS (SELECT satir_no, list_filter(string_split_regex(lower(text), '\\s+'), lambda y: y <> '') AS w FROM lab), ct AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM tk) GROUP BY word HAVING count(*) >= 5 ORDER BY n DESC, word LIMIT 498), "
    "vc AS (SELECT map_from_entries(list((word, id))) AS m FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM ct)), "
    "ix AS (SELECT satir_no, list_transform(w[1:12], lambda y: CAST(coalesce(m[y], 1) AS VARCHAR)) AS i FROM tk, vc) SELECT satir_no, array_to_string(list_concat(i, list_transform(range(12 - len(i)), lambda z: '0')), ' ') AS ids FROM ix",
)


def _training_run(s, d):
    x = labelled(s, d).withColumn("split", tables.split_of(F.col("text")))
    trainer = ml.Trainer("words", lambda train, rest: ml.baseline_scores(rest, train=train, features=1 << 12))
    return ml.run_training(x, [trainer], budget=0.05).select("model", "split", "tp", "fp", "tn", "fn")


QUERIES["training_run"] = (_training_run, None)
QUERIES["word2vec"] = (lambda s, d: (lambda m, x: ml.embedding_rows(m, ml.vocabulary(x, min_count=5, most=500)).select(F.col("id").cast("long").alias("id"), F.size("vector").alias("size")))(ml.word2vec(labelled(s, d), size=16, min_count=5, epochs=1), labelled(s, d)), f"WITH {L}, ct AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda y: y <> '')) AS word FROM lab) GROUP BY word HAVING count(*) >= 5 ORDER BY n DESC, word LIMIT 498) SELECT row_number() OVER (ORDER BY n DESC, word) + 1 AS id, 16 AS size FROM ct UNION ALL SELECT 0, 16 UNION ALL SELECT 1, 16")
