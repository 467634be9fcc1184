"""Views of the test tables in the roles that queries use, in both dialects."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.rules import Lexicon
from winnow.operators.tables import sentences, use_checkpoints

#: The tables hold no Turkish; rules are queried with frequent words of the tables instead.
TEST_LEXICON = Lexicon(
    terms=("the", "sch", "que", "ionion", "idiot", "loser", "moron", "scum"), contextual=("the", "que"), phrases=(r"\bof\s+the\b", r"\bde\s+la\b", r"der\s*die")
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df dealt over all tasks: a file of few row groups is otherwise worked on by as few."""
    return df.repartition(key)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("text", F.col("toxic").alias("label"), F.col("source").alias("kaynak"), F.lit("documents").alias("dosya"), F.col("doc_id").alias("satir_no"))


def labelled_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(labelled(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, label, p) with p in exact thousandths."""
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))
    p = F.pmod(F.col("row_id") * F.lit(37) + F.col("label") * 450 + F.col("m") * 61, F.lit(1000)).cast("double") / 1000
    return lab.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat(F.lit("m"), F.col("m")).alias("model"), "row_id", "label", p.alias("p"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), "role", "text")


L = "lab AS (SELECT d.text, l.toxic AS label, d.source AS kaynak, 'documents' AS dosya, d.doc_id AS satir_no FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
S = (
    L + ", sent AS (SELECT trim(s) AS text, label, kaynak, dosya, satir_no FROM "
    "(SELECT unnest(string_split_regex(text, '[.\\n]+')) AS s, label, kaynak, dosya, satir_no FROM lab) WHERE trim(s) <> '')"
)
P = (
    "sc AS (SELECT 'm' || CAST(m AS VARCHAR) AS model, doc_id AS row_id, toxic AS label, "
    "CAST((doc_id * 37 + toxic * 450 + m * 61) % 1000 AS DOUBLE) / 1000 AS p FROM labels, (VALUES (0), (1)) t(m)), "
    "s0 AS (SELECT * FROM sc WHERE model = 'm0')"
)
M = "msg AS (SELECT conv_id AS user_id, turn AS seq, role, text FROM conversations)"

Query = Callable[[SparkSession, str], DataFrame]


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names for checkpoints; a local one where all runs here."""
    use_checkpoints(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/plans-{uuid.uuid4().hex}"
