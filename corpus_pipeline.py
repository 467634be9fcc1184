"""Corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents.  Stages change texts or drop rows; the columns lang, source
and n_chars follow their document, n_chars as counted on the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from winnow.llm.tables import discard, materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base counts or the compression bands reject go.

    Null and empty texts have no words and go.  Rows are judged alone, whole texts of any length:
    repeated rows share a fate, null ids stay null; other columns are left behind.
    """
    judged = quality_rules.quality_rules(docs, carry=("text", *_REST))
    return judged.filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document; documents left without a word go, null and empty ones too.

    Rows that repeat a doc_id are one document to the counts and each keep their row.
    """
    out = line_dedup.line_dedup(docs, carry=_REST).withColumnRenamed("kept_text", "text")
    return out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity 0.8) the least doc_id stays.

    Rows that repeat doc_id and text stay as one, that of the least other columns.  Rows with a
    null doc_id all stay: they take part in no link, and nothing says which are one document.
    """
    named = docs.filter("doc_id IS NOT NULL")
    classes = jaccard_join.jaccard_classes(named, n=5, percent=80)
    first = classes.filter("doc_id = component_id").select("doc_id").distinct()
    kept = named.join(first, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*_REST)).alias("_rest"))
    return kept.select("doc_id", "text", "_rest.*").union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document's second pass is a row of its own.

    Null sources are a source of their own; null and empty texts give no row, repeated rows each theirs.
    """
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return mixing.taken_texts(mixed).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as packing.pack gives them: each row is packed, repeated ones and null ids too."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next; what a stage read goes."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
