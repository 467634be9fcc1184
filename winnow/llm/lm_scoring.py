"""LM scoring: a gated recurrent language model beside smoothed word frequencies.

Word counts come from all training documents.  The most frequent words form the model's
vocabulary; every other word is the model's unknown token times the word's smoothed share of
unknown words, so the model's probabilities of all words sum to one.  The model is trained on all
training documents: one learner starts, then rounds of PARALLEL learners and more go on from the
average of the round before, each learner on documents of its own, so that what is learned grows
with the corpus.  Averages are taken in a tree.

Counts of frequent words are broadcast (a fixed number of words of bounded length); each other
word meets its count in a join, pre-aggregated per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .gru import Gru, one_thread
from .tables import discard, materialize, read

#: No word contains a blank, so this stands for the end token among words.
END = " "
FREQUENT_WORDS, FREQUENT_BYTES = 1 << 17, 64
SCORE_BYTES = 16 << 20
#: Learners of a round at least, rounds at most, learners that one task averages.
PARALLEL, ROUNDS, FAN_IN = 32, 16, 32


class Lexicon:
    """Counts of frequent words, and the model's ids of the most frequent ones."""

    def __init__(self, rows: list[tuple[str, int]], vocabulary: int, tokens: int, documents: int) -> None:
        self.place = {w: k for k, (w, _) in enumerate(rows)}
        own = [(w, c) for w, c in rows if w != END][: vocabulary - 2]
        unknown = tokens - documents - sum(c for _, c in own)
        ranked = sorted([*own, (END, documents), ("", unknown)], key=lambda r: (-r[1], r[0]))
        self.ids = {w: k for k, (w, _) in enumerate(ranked)}
        self.model_counts = np.array([c for _, c in ranked], np.float64)
        self.unknown_tokens = unknown
        self.unknown = self.ids[""]
        self.end = self.ids[END]
        # by place, and at -1 for a word that has none
        self.counts = np.array([*(c for _, c in rows), -1], np.int64)
        self.id_of = np.array([*(self.ids.get(w, self.unknown) for w, _ in rows), self.unknown], np.int64)
        self.inside = np.array([*(w in self.ids for w, _ in rows), False], bool)

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model ids of all documents with their end tokens, their starts, and the place of each word of the vocabulary."""
        get = self.place.get
        places = np.fromiter((get(w, -1) for w in words.vocabulary.to_pylist()), np.int64, len(words.vocabulary))
        of = self.id_of[places]
        n = len(words.starts) - 1
        starts = words.starts + np.arange(n + 1)
        ids = np.full(len(words.codes) + n, self.end, np.int64)
        real = np.ones(len(ids), bool)
        real[starts[1:] - 1] = False
        ids[real] = of[words.codes]
        return ids, starts, places


#: Counts up to this are told apart where words are ranked by count; above it first on a log scale.
EXACT = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """word, count over docs' texts; each text ends with one end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, size=SCORE_BYTES):
            words = W.split(batch.column("text"), lower=True)
            n = np.bincount(words.codes, minlength=len(words.vocabulary))
            yield pa.RecordBatch.from_arrays([words.vocabulary.cast(pa.string()), pa.array(n, pa.int64())], ["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows], pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(training: DataFrame, lexicon: Lexicon, *, tokens: int, learner_tokens: int, seed: int = 5) -> np.ndarray:
    """Parameters after one learner's start and one pass over all documents, in rounds that are averaged.

    Documents are dealt by hash to learners of about learner_tokens of the tokens.  A round has at
    least PARALLEL learners, so far as there are, and there are at most ROUNDS rounds.
    """
    spark = training.sparkSession
    flat = Gru(lexicon.model_counts, seed=seed).flat()
    if not tokens:
        return flat
    learners = -(-tokens // learner_tokens)
    rounds = min(ROUNDS, -(-learners // PARALLEL))
    known = spark.sparkContext.broadcast(lexicon)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, size=SCORE_BYTES):
            ids, starts, _ = known.value.encode(W.split(batch.column("text"), lower=True))
            data = pa.py_buffer(ids.astype("<u2").tobytes())
            blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((2 * starts).tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_learner"), blobs.cast(pa.binary())], ["_row", "_learner", "ids"])

    # ids travel once; a round then reads little besides its own rows
    dealt = training.select("_row", F.pmod(F.xxhash64(F.lit(seed + 1), "_row"), F.lit(learners)).alias("_learner"), "text")
    dealt = dealt.mapInArrow(encode, "_row long, _learner long, ids binary").repartition("_learner").sortWithinPartitions("_learner")
    dealt = materialize(dealt)
    schema = "k long, n long, w binary"

    def learner(flat: np.ndarray, epochs: int):
        def run(table: pa.Table) -> pa.Table:
            one_thread()
            own = [np.frombuffer(b, "<u2") for b in table.sort_by("_row").column("ids").to_pylist()]
            model = Gru(known.value.model_counts, seed=seed).load(flat)
            model.train(own, epochs=epochs)
            return _parameters(table.column("_learner")[0].as_py(), sum(map(len, own)), model.flat())

        return run

    def averaged(df: DataFrame, many: int, flat: np.ndarray, epochs: int) -> np.ndarray:
        held = df.groupBy("_learner").applyInArrow(learner(flat, epochs), schema)
        while many > FAN_IN:  # a task averages at most FAN_IN learners
            many = -(-many // FAN_IN)
            held = held.groupBy(F.floor(F.col("k") / FAN_IN).cast("long").alias("g")).applyInArrow(_mean, schema)
        rows = held.toArrow()
        return np.frombuffer(_mean(rows).column("w")[0].as_py(), np.float32) if rows.num_rows else flat

    flat = averaged(dealt.filter("_learner = 0"), 1, flat, 2)
    for r in range(rounds if learners > 1 else 0):
        first, last = learners * r // rounds, learners * (r + 1) // rounds
        flat = averaged(dealt.filter(F.col("_learner").between(first, last - 1)), last - first + FAN_IN, flat, 1)
    discard(dealt)
    return flat


def _parameters(key: int, tokens: int, flat: np.ndarray) -> pa.Table:
    columns = [pa.array([key], pa.int64()), pa.array([tokens], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())]
    return pa.Table.from_arrays(columns, ["k", "n", "w"])


def _mean(table: pa.Table) -> pa.Table:
    """Mean of parameters by tokens, in the order of their keys, so that reruns agree."""
    table = table.sort_by("k")
    n = table.column("n").to_numpy()
    out = sum(np.frombuffer(w, np.float32) * (k / n.sum()) for w, k in zip(table.column("w").to_pylist(), n.tolist(), strict=True))
    return _parameters(table.column("k")[0].as_py() // FAN_IN, int(n.sum()), out)


def most_frequent(counts: DataFrame, limit: int) -> list[tuple[str, int]]:
    """Exactly the first limit words (word, c) by falling count, then by a hash of the word.

    The driver sees how many words have each count up to EXACT, and on a log scale above it; if the
    limit falls within a step of that scale, those of its counts; and, besides the words themselves,
    about as many more of the last count.
    """

    def last(groups: DataFrame, room: int) -> tuple[int | None, int, int]:
        """The first group, from the highest on, that does not fit whole, its words, and what room is left for it."""
        for g, k in sorted(((r["g"], r["count"]) for r in groups.groupBy("g").count().collect()), reverse=True):
            if k > room:
                return g, k, room
            room -= k
        return None, 0, room

    step = F.floor(F.log2("c") * 16) + EXACT
    edge, tied, room = last(counts.select(F.when(F.col("c") <= EXACT, F.col("c")).otherwise(step).alias("g")), limit)
    if edge is not None and edge > EXACT:
        above = counts.filter(F.col("c") > EXACT)
        edge, tied, room = last(above.filter(step >= edge).select(F.col("c").alias("g")), limit)
    if edge is None:
        return [(r["word"], int(r["c"])) for r in counts.collect()]
    mark = F.pmod(F.xxhash64("word"), F.lit(1 << 40))
    share = min(1.0, 2 * room / tied)
    while True:
        drawn = (F.col("c") > edge) | (F.col("c") == edge) & (mark < F.lit(share * (1 << 40)))
        found = counts.filter(drawn).select("word", "c", mark.alias("m")).collect()
        if len(found) >= limit:
            break
        share = min(1.0, 2 * share)
    found.sort(key=lambda r: (-r["c"], r["m"], r["word"]))
    return [(r["word"], int(r["c"])) for r in found[:limit]]


def lm_scores(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 5,
    held: int = 1,
    vocabulary: int = 2048,
    learner_tokens: int = 1 << 20,
) -> DataFrame:
    """Log10 probability of every whole text under word frequencies and under the recurrent model.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.  Rows whose crc32(doc_id as text) mod folds is held are held out of all learning.

    * Tokens are words folded A-Z and one end token.  A null text is empty: its end token alone.
    * Texts count whole, whatever their length: the state goes on to a text's end.
    * Words never seen have count 0; the model gives all of them together half a count.
    * A null doc_id is not held out.  Repeated rows count each time; equal texts get equal scores.
    * Without training rows V and N are 0: base_score is 0 and the model is its start.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.select("_id", F.xxhash64("_id", "text").alias("_row"), "text")
    kind = docs.schema["_id"].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    training = docs.filter(~held_out)
    counts = materialize(word_counts(training))
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("d")).first()
    n, v, ends = int(totals["n"] or 0), int(totals["v"]), int(totals["d"] or 0)
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    rows = most_frequent(short, FREQUENT_WORDS)
    rows.sort(key=lambda r: (-r[1], r[0]))
    lexicon = Lexicon(rows, vocabulary, n, ends)
    parameters = train(training, lexicon, tokens=n, learner_tokens=learner_tokens)
    shared = spark.sparkContext.broadcast((lexicon, parameters))
    below = n + 0.5 * (v + 1)
    # all unknown words' smoothed counts: the known ones outside the vocabulary, and the unseen
    unknown_below = lexicon.unknown_tokens + 0.5 * (v - (len(lexicon.ids) - 1) + 1) if v else 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        known, flat = shared.value
        model = Gru(known.model_counts).load(flat)
        for batch in W.steps(batches, size=SCORE_BYTES):
            words = W.split(batch.column("text"), lower=True)
            ids, starts, places = known.encode(words)
            logs = model.score(ids, starts) / math.log(10)
            c, lies_in, names = known.counts[places], known.inside[places], words.vocabulary
            owner = np.repeat(np.arange(batch.num_rows), words.counts)

            def summed(x: np.ndarray, owner=owner, words=words, rows=batch.num_rows) -> np.ndarray:
                return np.bincount(owner, weights=x[words.codes], minlength=rows)

            value = np.log10(np.maximum(c, 0) + 0.5) * (c >= 0)
            base, outside = summed(value), summed(value * ~lies_in)
            n_unknown, n_known = summed((~lies_in).astype(float)), summed((c > 0).astype(float))
            # words whose count is not at hand, once per document
            rare = np.flatnonzero(c[words.codes] < 0) if len(words.codes) else np.empty(0, np.int64)
            pairs, times = np.unique(owner[rare] * max(len(names), 1) + words.codes[rare], return_counts=True)
            text_of, code = pairs // max(len(names), 1), pairs % max(len(names), 1)
            bounds = pa.array(np.searchsorted(text_of, np.arange(batch.num_rows + 1)), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, words.vocabulary.take(pa.array(code)).cast(pa.string()))
            tf = pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))
            columns = [batch.column("_id"), batch.column("_row"), pa.array(words.counts + 1, pa.int64())]
            columns += [pa.array(x.astype(np.float64)) for x in (n_known, base, outside, n_unknown, logs)]
            yield pa.RecordBatch.from_arrays([*columns, lists, tf], ["_id", "_row", "n_tokens", "_known", "_base", "_outside", "_unknown", "_model", "_rare", "_times"])

    schema = f"_id {kind}, _row long, n_tokens long, _known double, _base double, _outside double, _unknown double, _model double, _rare array<string>, _times array<int>"
    scored = materialize(docs.mapInArrow(score, schema))
    rare = scored.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_row", F.col("x._rare").alias("word"), F.col("x._times").alias("t"))
    c = F.coalesce("c", F.lit(0))
    found = (
        rare.join(counts, "word", "left")
        .groupBy(F.col("_row").alias("_of"))
        .agg(F.sum(F.col("t") * F.log10(c + 0.5)).alias("_sum"), F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("_seen"), F.sum("t").alias("_all"))
    )
    # rows that repeat doc_id and text were summed together above
    repeats = scored.groupBy(F.col("_row").alias("_same")).agg(F.count("*").alias("_rows"))
    joined = scored.drop("_rare", "_times").join(found, F.col("_row") == F.col("_of"), "left").join(repeats, F.col("_row") == F.col("_same"))
    extra: Column = F.coalesce("_sum", F.lit(0.0)) / F.col("_rows")
    end_base = math.log10(ends + 0.5)
    return joined.select(
        F.col("_id").alias(doc_id),
        held_out.alias("held_out"),
        "n_tokens",
        (F.round("_known") + F.coalesce(F.col("_seen") / F.col("_rows"), F.lit(0.0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") + extra + end_base - F.col("n_tokens") * math.log10(below)).alias("base_score"),
        (F.col("_model") + F.col("_outside") + extra - F.col("_unknown") * math.log10(unknown_below)).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
