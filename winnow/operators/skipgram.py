"""Skip-gram word vectors whose vocabulary stays in tables: no process holds more than one part's words.

Rows are dealt to parts.  In an epoch each part takes the vectors of its own words by a join, learns
on its texts with negative sampling, and the vectors of a word are averaged over the parts that hold
it, weighted by its occurrences there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.tables import removed, stored

#: Tokens of a part, about, where the caller names no number of parts.
PART_TOKENS = 2_000_000
RATE, LEAST_RATE = 0.025, 0.0001
#: Wrong words for each right one; drawn from SHARED words that all pairs of a step have in common.
NEGATIVES, SHARED = 5, 64
#: Positions of a step, and how many of its updates of one word are added up; more are averaged to that many.
STEP, ADDED = 512, 16


@dataclass(frozen=True)
class WordVectors:
    """A fitted model; its vectors are a table."""

    vectors: DataFrame
    size: int
    partitions: int

    def getVectors(self) -> DataFrame:  # noqa: N802 - the names of pyspark.ml's model
        from pyspark.ml.functions import array_to_vector

        return self.vectors.select("word", array_to_vector("vector").alias("vector"))

    def getVectorSize(self) -> int:  # noqa: N802
        return self.size

    def getNumPartitions(self) -> int:  # noqa: N802
        return self.partitions


def _add(to: np.ndarray, at: np.ndarray, steps: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    many = np.diff(np.append(first, len(at)))
    to[at[first]] += np.add.reduceat(steps[order], first, axis=0) * np.minimum(1, ADDED / many)[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(words: np.ndarray, text: np.ndarray, n: np.ndarray, inner: np.ndarray, outer: np.ndarray, window: int, rng: np.random.Generator, done: float, share: float) -> None:
    """One epoch over words (rows of inner and outer, which change) of the texts numbered in text.

    n: occurrences of each word; done and share: what of all epochs lies behind, and what this one is.
    """
    heaps = np.cumsum(n.astype(np.float64) ** 0.75)
    away = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    for lo in range(0, len(words), STEP):
        rate = np.float32(max(LEAST_RATE, RATE * (1 - done - share * lo / len(words))))
        here = np.arange(lo, min(lo + STEP, len(words)))
        there = here[:, None] + away
        ok = (np.abs(away) <= rng.integers(1, window + 1, len(here))[:, None]) & (there >= 0) & (there < len(words))
        row, column = np.nonzero(ok & (text[np.clip(there, 0, len(words) - 1)] == text[here][:, None]))
        if not len(row):
            continue
        a, b = words[here[row]], words[there[row, column]]
        x, y = inner[a], outer[b]
        wrong = np.searchsorted(heaps, rng.random(SHARED) * heaps[-1], side="right")
        z = outer[wrong]
        right = rate * (1 - _sigmoid((x * y).sum(axis=1)))[:, None]
        false = rate * np.float32(NEGATIVES / SHARED) * _sigmoid(x @ z.T) * (wrong[None, :] != b[:, None])
        _add(inner, a, right * y - false @ z)
        _add(outer, b, right * x)
        # a shared word stands for a few draws of each pair: its steps are added up like those of ADDED pairs
        _add(outer, wrong, false.T @ -x * np.float32(min(1, ADDED * SHARED / (NEGATIVES * len(row)))))


def _rows(table: pa.Table, column: str, size: int) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy().reshape(-1, size)


def _lists(values: np.ndarray) -> pa.Array:
    many, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * size, pa.int32()), pa.array(values.astype(np.float32).ravel()))


def _written(df: DataFrame) -> DataFrame:
    """stored, and the job's shuffle files go at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    try:
        conf.set(key, "true")
        return stored(df)
    finally:
        conf.set(key, before)


def fit(df: DataFrame, words: str, size: int, window: int, min_count: int, epochs: int, partitions: int | None, least_partitions: int, seed: int) -> WordVectors:
    """Vectors of all words of df's arrays of words that occur min_count times.

    partitions: parts; None: one for each PART_TOKENS tokens, least_partitions at least.
    """
    # written, so that df is read once and the dealing is the same in each epoch
    rows = _written(df.select(F.coalesce(words, F.array().cast("array<string>")).alias("w"), F.monotonically_increasing_id().alias("row")))
    if partitions is None:
        tokens = rows.agg(F.sum(F.size("w"))).first()[0] or 0
        partitions = max(least_partitions, math.ceil(tokens / PART_TOKENS))
    part = F.pmod(F.xxhash64("row"), F.lit(partitions)).cast("int").alias("part")
    held = rows.select(part, F.explode("w").alias("word")).groupBy("part", "word").agg(F.count("*").alias("n"))
    known = _written(rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("word"))
    held = _written(held.join(known, "word"))
    texts = rows.select(part, "row", F.array_join("w", " ").alias("text"))
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: ((F.pmod(F.xxhash64("word", k, F.lit(seed)), F.lit(1 << 24)) / (1 << 24) - 0.5) / size).cast("float"))
    model = known.select("word", start.alias("inner"), F.array_repeat(F.lit(0.0).cast("float"), size).alias("outer"))
    tasks = max(partitions, 8 * min(partitions, 32))  # a named number is not coalesced; few parts rarely share a task
    kind = "word string, inner array<float>, outer array<float>"

    def mean(table: pa.Table) -> pa.Table:
        coded = table.column("word").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
        n = table.column("n").to_numpy().astype(np.float64)[order]
        sums = np.add.reduceat(n, first)[:, None]
        both = [np.add.reduceat(_rows(table, c, size)[order] * n[:, None], first, axis=0) / sums for c in ("inner", "outer")]
        return pa.table({"word": coded.dictionary, "inner": _lists(both[0]), "outer": _lists(both[1])})

    for epoch in range(epochs):

        def learned(key: tuple, own: pa.Table, vectors: pa.Table) -> pa.Table:  # pickled in its own epoch
            vectors = vectors.sort_by("word")
            names, n = vectors.column("word").combine_chunks(), vectors.column("n").to_numpy()
            inner, outer = _rows(vectors, "inner", size).copy(), _rows(vectors, "outer", size).copy()
            if len(names):
                lists = pc.split_pattern(own.sort_by("row").column("text").combine_chunks(), " ")
                coded = lists.flatten().dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy()
                at = place[coded.indices.to_numpy()]
                text = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy())
                rng = np.random.default_rng([seed, epoch, key[0].as_py()])
                learn(at[at >= 0], text[at >= 0], n, inner, outer, window, rng, epoch / epochs, 1 / epochs)
            if epoch + 1 == epochs:
                outer[:] = 0  # nothing reads them any more, and zeros travel compressed
            return pa.table({"word": names, "n": n, "inner": _lists(inner), "outer": _lists(outer)})

        own, vectors = (x.repartition(tasks, "part").groupBy("part") for x in (texts, held.join(model, "word")))
        parts = own.cogroup(vectors).applyInArrow(learned, "word string, n long, inner array<float>, outer array<float>")
        buckets = parts.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(partitions)))
        last, model = model, _written(buckets.groupBy("bucket").applyInArrow(mean, kind))
        removed(last)
    model = model if epochs else _written(model)
    removed(rows, held, known)
    return WordVectors(model.select("word", F.col("inner").cast("array<double>").alias("vector")), size, partitions)
