"""Line dedup: lines that many documents share stay only in the last of these documents.

Lines are exploded with their position, their normalised key is hashed to 128 bits, documents
are counted per hash, and only positions of lines to drop travel back to the documents.  All
steps are DataFrame functions.  Counting pre-aggregates before each exchange.  Occurrences and
frequent lines are written before they meet: adaptive execution can split a join of two plain
exchanges, so one line held by a third of all documents does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import carried, discard, materialize, read, uncarried

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_dedup(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Drop lines shared by at least min_docs documents, except in the largest doc_id holding them.

    Returns one row per input row: doc_id, n_lines, n_dropped, kept_text, then the carried columns.

    * Texts are split whole, whatever their length: their lines are rows until they are joined again.
    * A null or empty text is one empty line and is returned as the empty text.
    * Keys shorter than min_chars code points are never counted nor dropped.
    * Documents are counted by distinct doc_id; rows that repeat a doc_id count once and are each
      returned, with their own lines.  A null doc_id is no document: it is not counted and never
      the largest, so its shared lines are dropped.
    * Ties cannot occur, as one doc_id is the largest.  An empty table gives an empty result.
    * Other columns are ignored unless carried, whatever their names.
    """
    docs = documents.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        carried(carry).alias("_carry"),
    )
    # rows that repeat a doc_id, or have none, are kept apart by their texts' 128 bits
    docs = docs.withColumns({"_r1": F.xxhash64(F.lit(3), "_text"), "_r2": F.xxhash64(F.lit(4), "_text")})
    occurrences = materialize(
        docs.select("_id", "_r1", "_r2", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_r1", "_r2", "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .select(F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"), "_id", "_r1", "_r2", "_pos")
    )
    frequent = materialize(
        occurrences.groupBy("_h1", "_h2")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_last"))
        .filter(F.col("_n") >= min_docs)
        .select("_h1", "_h2", "_last")
    )
    drops = materialize(
        occurrences.join(frequent, ["_h1", "_h2"])
        .filter(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("_id").alias("_of"), F.col("_r1").alias("_of1"), F.col("_r2").alias("_of2"))
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    discard(occurrences, frequent)
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_r1") == F.col("_of1")) & (F.col("_r2") == F.col("_of2"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drop", F.array().cast("array<int>")))
    # the one-element array binds the split lines once for all positions
    joined = F.transform(
        F.array("_lines"),
        lambda lines: F.array_join(F.transform("_kept", lambda k: F.get(lines, k)), "\n"),
    )[0]
    return (
        docs.join(drops, same, "left")
        .withColumn("_lines", F.split("_text", "\n", -1))
        .withColumn("_kept", kept)
        .select(
            F.col("_id").alias(doc_id),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
            joined.alias("kept_text"),
            *uncarried(carry),
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.last <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
