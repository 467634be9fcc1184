"""The most similar term of each word, for lexicons and vocabularies of any size.

Similar means a sequence ratio 2 M / (a + b) of at least `score` hundredths after rounding, where M
characters match in order between a word of a and a term of b characters.  So both have a common
subsequence of m = ceil((2 score - 1) (a + b) / 400) characters, and that gives keys to join on:

* where neither side loses more than DEPTH characters, the forms of m characters that deletions
  leave: a pair shares one exactly if it has such a subsequence;
* beyond, pieces: at most e = a + b - 2 m characters are unmatched, so of e + 1 pieces of the term one
  stands unbroken in the word, moved by at most the characters that either side loses.

Both are plain equi-joins on (a, b, key) that Spark deals and splits; only pairs that share a key are
compared by the ratio.  Words in lower case and plain letters; empty forms are like nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.rules import plain_letters

#: Deletions per side up to which forms are keys; a word of 20 letters has 190 forms of two deletions.
DEPTH = 2


def _shorter(forms: Column) -> Column:
    """Each form without one of its characters, in every way."""

    def without(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))

    return F.array_distinct(F.flatten(F.transform(forms, without)))


def _forms(form: Column, lost: Column) -> Column:
    out, levels = F.array(form), F.array(form)
    choice = F.when(lost == 0, out)
    for depth in range(1, DEPTH + 1):
        levels = _shorter(levels)
        choice = choice.when(lost == depth, levels)
    return choice


def _cut(i: Column, b: Column, n: Column) -> Column:
    return F.floor(b * i / n).cast("int")


def _pieces(form: Column, b: Column, n: Column) -> Column:
    """Numbered pieces of a term."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(i, F.lit(":"), form.substr(_cut(i, b, n) + 1, _cut(i + 1, b, n) - _cut(i, b, n))))


def _stretches(form: Column, a: Column, b: Column, m: Column, n: Column) -> Column:
    """What stands in a word where a term's numbered pieces could be."""

    def at(i: Column) -> Column:
        size = _cut(i + 1, b, n) - _cut(i, b, n)
        starts = F.filter(F.transform(F.sequence(m - b, a - m), lambda move: _cut(i, b, n) + move), lambda s: (s >= 0) & (s + size <= a))
        return F.transform(starts, lambda s: F.concat(i, F.lit(":"), form.substr(s + 1, size)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


def _keyed(df: DataFrame, own: str, other: str, lengths: DataFrame, apart: int, score: int) -> DataFrame:
    """form, a, b and one row a key; own is the length of the rows' forms, other that of the other side's."""
    near = F.explode(F.sequence(F.greatest(F.lit(1), F.col(own) - apart), F.col(own) + apart))
    x = df.withColumn(own, F.length("form")).withColumn(other, near)
    x = x.join(lengths.withColumnRenamed("length", other), other, "left_semi")  # the other side has such forms
    x = x.withColumn("m", F.ceil(F.lit(2 * score - 1) * (F.col("a") + F.col("b")) / 400).cast("int")).filter("m <= least(a, b)")
    form, a, b, m = (F.col(c) for c in ("form", "a", "b", "m"))
    n = a + b - 2 * m + 1
    pieces = _pieces(form, b, n) if own == "b" else _stretches(form, a, b, m, n)
    keys = F.when(F.greatest(a, b) - m <= DEPTH, _forms(form, F.col(own) - m)).otherwise(pieces)
    return x.select("form", "a", "b", F.explode(keys).alias("key"))


def candidates(words: DataFrame, terms: DataFrame, apart: int = 2, score: int = 90) -> DataFrame:
    """Distinct pairs (word, term) of forms that share a key; both inputs have a column form."""
    if not 75 <= score <= 100:
        raise ValueError("score is from 75 to 100: below, pieces would be empty")
    sides = [df.filter("form <> ''").select("form").distinct() for df in (words, terms)]
    lengths = [df.select(F.length("form").alias("length")).distinct() for df in sides]
    w = _keyed(sides[0], "a", "b", lengths[1], apart, score).withColumnRenamed("form", "word")
    t = _keyed(sides[1], "b", "a", lengths[0], apart, score).withColumnRenamed("form", "term")
    return w.join(t, ["a", "b", "key"]).select("word", "term").distinct()


def similarities(pairs: DataFrame) -> DataFrame:
    """score of each pair (word, term): the rounded ratio in hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("word").to_pylist(), batch.column("term").to_pylist(), strict=True)
            yield batch.append_column("score", pa.array([round(100 * SequenceMatcher(None, u, v).ratio()) for u, v in both], pa.int32()))

    return pairs.mapInArrow(run, "word string, term string, score int")


def nearest(words: DataFrame, terms: DataFrame, least: int = 4, apart: int = 2, score: int = 90) -> DataFrame:
    """word, term and score of each distinct word (column word) that reaches score; the best term, of equals the first.

    terms has columns term and rank (their order).  Words of fewer than `least` characters and terms that
    differ by more than `apart` in length are not compared.  Null words and terms are left out.
    """
    w = words.filter(F.length("word") >= least).select("word", plain_letters(F.lower("word")).alias("form")).distinct()
    t = terms.filter("term IS NOT NULL").select("term", "rank", plain_letters(F.lower("term")).alias("form"))
    t = t.groupBy("form").agg(F.min(F.struct("rank", "term")).alias("first"))
    found = similarities(candidates(w, t, apart, score)).filter(F.col("score") >= score)
    ranked = found.join(t.withColumnRenamed("form", "term"), "term").groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("less"), "first")).alias("best"))
    return w.join(ranked.withColumnRenamed("word", "form"), "form").select("word", F.col("best.first.term").alias("term"), (-F.col("best.less")).alias("score"))
