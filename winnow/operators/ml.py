"""Word vectors, and a linear baseline scorer on pyspark.ml; neural models plug in through score_with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.text import tokens
from winnow.operators import evaluate, skipgram


#: Learners at least, and rows of a learner at least where there are more.
LEARNERS, LEARNER_ROWS = 4, 1000


def learners(df: DataFrame) -> int:
    """Parts that learn side by side: as many as run at once, while each has LEARNER_ROWS rows."""
    return max(LEARNERS, min(df.sparkSession.sparkContext.defaultParallelism, df.count() // LEARNER_ROWS))


def word2vec(df: DataFrame, text: str = "text", size: int = 192, window: int = 5, min_count: int = 2, epochs: int = 10, partitions: int | None = None, seed: int = 42):
    """A fitted skip-gram model over df's texts; fit on the training split only.

    partitions: parts that learn on their own and are averaged after each epoch; None: learners(df), or
    as many as keep a part to skipgram.PART_TOKENS tokens.  Vectors depend on their number.
    """
    least = learners(df) if partitions is None else partitions
    words = df.select(tokens(F.lower(text)).alias("words"))
    return skipgram.fit(words, "words", size, window, min_count, epochs, partitions, least, seed)


PAD, UNKNOWN = 0, 1


def vocabulary(df: DataFrame, text: str = "text", min_count: int = 2, most: int = 30_000) -> DataFrame:
    """word and id of the most frequent words of the training split, ids from 2 on; ties by word."""
    counts = df.select(F.explode(tokens(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    top = counts.orderBy(F.desc("n"), "word").limit(most - 2)
    return top.select("word", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 1).alias("id"))  # most rows at most


def vectorised(df: DataFrame, words: DataFrame, text: str = "text", length: int = 192) -> DataFrame:
    """df with ids: the first length words as numbers, UNKNOWN for others, PAD behind the last.

    words (word, id) has a bounded number of rows and is sent to all tasks as one map.
    """
    table = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "id"))).alias("_ids"))
    own = F.transform(F.slice(tokens(F.lower(F.coalesce(text, F.lit("")))), 1, length), lambda w: F.coalesce(F.element_at("_ids", w), F.lit(UNKNOWN)))
    padded = F.concat("_own", F.array_repeat(F.lit(PAD), F.lit(length) - F.size("_own")))
    return df.crossJoin(F.broadcast(table)).withColumn("_own", own).withColumn("ids", padded).drop("_ids", "_own")


def embedding_rows(model, words: DataFrame) -> DataFrame:
    """id and vector of each word of the vocabulary, of UNKNOWN (their mean) and PAD (zeros)."""
    from pyspark.ml.functions import vector_to_array

    vectors = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    own = words.join(vectors, "word").select("id", "vector")
    size = model.getVectorSize()
    mean = own.agg(F.array(*[F.avg(F.col("vector")[k]) for k in range(size)]).alias("vector")).select(F.lit(UNKNOWN).alias("id"), "vector")
    zeros = own.sparkSession.createDataFrame([(PAD, [0.0] * size)], "id int, vector array<double>")
    return own.union(mean).union(zeros)


@dataclass(frozen=True)
class Trainer:
    """A model of a training run: scores(train, df) gives df with p; order: lesser ones run first."""

    name: str
    scores: Callable[[DataFrame, DataFrame], DataFrame]
    order: int = 0


def run_training(splits: DataFrame, trainers: list[Trainer], budget: float = 0.01, dry_run: bool = False) -> DataFrame:
    """Metrics of each model on valid and test: model, split, temperature, threshold and all metrics.

    Fitted on train; temperature and threshold come from valid alone, so test decides nothing.  A dry
    run only checks that the three splits have rows of both labels and returns the models in order.
    """
    spark = splits.sparkSession
    ordered = sorted(trainers, key=lambda t: (t.order, t.name))
    labels = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count_distinct("label").alias("n")).collect()}
    if wrong := [s for s in ("train", "valid", "test") if labels.get(s, 0) < 2]:
        raise ValueError(f"splits without both labels: {', '.join(wrong)}")
    if dry_run:
        return spark.createDataFrame([(t.name, k) for k, t in enumerate(ordered)], "model string, place int")
    parts = {s: splits.filter(F.col("split") == s) for s in ("train", "valid", "test")}
    out = None
    for trainer in ordered:
        scored = trainer.scores(parts["train"], parts["valid"].unionByName(parts["test"])).select("split", "label", "p")
        temperature = evaluate.fit_temperature(scored.filter("split = 'valid'")).first()["temperature"]
        warm = scored.withColumn("p", evaluate.tempered(F.col("p"), temperature))
        threshold = evaluate.select_threshold(warm.filter("split = 'valid'"), budget).first()["threshold"]
        row = evaluate.metrics(evaluate.confusion(warm, threshold, "split"))
        row = row.select(F.lit(trainer.name).alias("model"), F.lit(temperature).alias("temperature"), F.lit(threshold).alias("threshold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def baseline_scores(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14, train: DataFrame | None = None) -> DataFrame:
    """df with p, the probability of label 1 by logistic regression over hashed words, fitted on train (None: df)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    hashing = HashingTF(numFeatures=features, binary=True, inputCol="_words", outputCol="_features")

    def hashed(rows: DataFrame) -> DataFrame:
        return hashing.transform(rows.withColumn("_words", tokens(F.lower(text))))

    model = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=10, regParam=0.01).fit(hashed(df if train is None else train))
    return model.transform(hashed(df)).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def score_with(df: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "text") -> DataFrame:
    """df with p from any model: load() runs once per task and gives a function of a batch of texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in parts:
            yield pdf.assign(p=predict(pdf[text].fillna("").tolist()))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))
