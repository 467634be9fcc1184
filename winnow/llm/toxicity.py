"""Toxicity: a linear classifier that is regularised by counterfactual identity swaps.

Features are the distinct words of a text and their beginnings, hashed.  The most telling
features and those of all group terms are chosen on the labelled sample, then a logistic model is
fitted with one more penalty: labelled texts that mention a group are copied with the group's term
swapped for another group's, and the squared change of the score counts as loss.  A labelled text
that mentions no group gets a term, the same for equal texts, so that the penalty works on any
corpus.  Neutral mentions of a group so carry no weight of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import discard, materialize, read

BITS = 18
PREFIXES = (4, 5, 6)
EDGE = ".,;:!?()[]{}\"'|#*$%&<>-_"

#: Terms that name groups of people; terms of one row may stand for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("muslime", "christen", "juden", "frauen", "männer", "ausländer"),
    ("musulmans", "chrétiens", "juifs", "femmes", "hommes", "étrangers"),
    ("musulmanes", "cristianos", "judíos", "mujeres", "hombres", "extranjeros"),
)


def _feature(kind: int, word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode(), kind) >> (64 - BITS)


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself without marks at its edges, and its beginnings."""
    w = word.lower().strip(EDGE)
    if not w:
        return []
    return [_feature(0, w), *(_feature(n, w[:n]) for n in PREFIXES if len(w) >= n)]


@dataclass
class Model:
    """weights of the chosen features by hash; threshold lies at score 0.5."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))

    def scores(self, words: W.Words) -> np.ndarray:
        """Score of each text."""
        n = len(words.starts) - 1
        features, owners = [], []
        for k, w in enumerate(words.vocabulary.to_pylist()):
            for f in word_features(w):
                if self.weights[f]:
                    features.append(f)
                    owners.append(k)
        logit = np.full(n, self.bias)
        if features:
            own, feature = np.array(owners), np.array(features)
            count = np.bincount(own, minlength=len(words.vocabulary))
            first = np.cumsum(count) - count
            text = np.repeat(np.arange(n), words.counts)
            each = count[words.codes]
            ends = np.cumsum(each)
            take = np.repeat(first[words.codes] - (ends - each), each) + np.arange(int(ends[-1]))
            pairs = np.unique(np.repeat(text, each) << BITS | feature[take])
            logit = logit + np.bincount(pairs >> BITS, weights=self.weights[pairs & ((1 << BITS) - 1)], minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def swap_table(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term and the next one of its row."""
    return {t: row[(k + 1) % len(row)] for row in groups for k, t in enumerate(row)}


def term_features(groups: tuple[tuple[str, ...], ...]) -> np.ndarray:
    return np.unique([f for row in groups for t in row for f in word_features(t)]).astype(np.int64)


def telling(in_toxic: np.ndarray, in_all: np.ndarray, rows: int, toxic: int, features: int = 4096, min_rows: int = 4) -> np.ndarray:
    """The features that tell most of the label, by their numbers of toxic and of all labelled texts."""
    share = toxic / rows
    expected = in_all * share
    gain = (in_toxic - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    gain[in_all < min_rows] = 0
    chosen = np.argsort(-gain, kind="stable")[:features]
    return np.sort(chosen[gain[chosen] > 10.83])  # chi-square, one in a thousand by chance


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    *,
    chosen: np.ndarray | None = None,
    ridge: float = 1e-4,
    counterfactual: float = 1.0,
    rounds: int = 400,
    rate: float = 0.1,
) -> Model:
    """Fit on (features, features after the swap, label) of labelled texts; the same rows give the same model.

    Only chosen features get weights; None: the telling ones of these rows.
    """
    model = Model()
    y = np.array([r[2] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    if chosen is None:
        flat = np.concatenate([r[0] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        counts = [np.bincount(flat, weights=w, minlength=1 << BITS) for w in (y[owner], None)]
        chosen = telling(*counts, len(rows), int(y.sum()))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(which: int) -> tuple[np.ndarray, np.ndarray]:
        cols = place[np.concatenate([np.empty(0, np.int64), *(r[which] for r in rows)])]
        rows_ = np.repeat(np.arange(len(rows)), [len(r[which]) for r in rows])
        return rows_[cols >= 0], cols[cols >= 0]

    (r0, c0), (r1, c1) = matrix(0), matrix(1)
    share = y.mean()
    w, bias, n = np.zeros(len(chosen)), float(np.log(share / (1 - share))), len(rows)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r0, weights=w[c0], minlength=n), -40, 40)))
        q = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r1, weights=w[c1], minlength=n), -40, 40)))
        change = 2 * counterfactual * (p - q)
        a, b = (p - y) + change * p * (1 - p), -change * q * (1 - q)
        grad = (np.bincount(c0, weights=a[r0], minlength=len(w)) + np.bincount(c1, weights=b[r1], minlength=len(w))) / n + ridge * w
        grad = np.append(grad, (a + b).mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    model.bias = bias
    model.weights[chosen] = w
    return model


def featurised(labelled: DataFrame, groups: tuple[tuple[str, ...], ...]) -> DataFrame:
    """_id, _label, and the features of each labelled text before and after the swap."""
    swaps = swap_table(groups)
    terms = sorted(swaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            words = W.split(batch.column("text"))
            vocabulary = words.vocabulary.to_pylist()
            known = [word_features(w) for w in vocabulary]
            swapped = {k: word_features(swaps[w.lower().strip(EDGE)]) for k, w in enumerate(vocabulary) if w.lower().strip(EDGE) in swaps}
            before, after = [], []
            for lo, hi in zip(words.starts[:-1], words.starts[1:], strict=True):
                codes = np.unique(words.codes[lo:hi]).tolist()
                own, other = {f for c in codes for f in known[c]}, {f for c in codes for f in swapped.get(c, known[c])}
                if terms and not any(c in swapped for c in codes):
                    drawn = xxhash.xxh3_64_intdigest("\n".join(sorted(vocabulary[c] for c in codes)).encode(), 9)
                    term = terms[drawn % len(terms)]
                    own, other = own.union(word_features(term)), other.union(word_features(swaps[term]))
                before.append(np.array(sorted(own), "<i4").tobytes())
                after.append(np.array(sorted(other), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["_id", "_label", "before", "after"])

    return labelled.mapInArrow(run, f"_id {labelled.schema['_id'].dataType.simpleString()}, _label int, before binary, after binary")


def fitted(labelled: DataFrame, groups: tuple[tuple[str, ...], ...], counterfactual: float) -> Model:
    """Model of labelled texts; the driver gets counts of 2^18 features, then of each text only those chosen."""
    table = materialize(featurised(labelled, groups))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("before").to_pylist()
            y = np.repeat(batch.column("_label").to_numpy(), [len(b) // 4 for b in blobs])
            flat = np.frombuffer(b"".join(blobs), "<i4")
            toxic, n = np.bincount(flat, weights=y, minlength=1 << BITS), np.bincount(flat, minlength=1 << BITS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(toxic[at].astype(np.int64)), pa.array(n[at])], ["f", "t", "n"])

    got = table.mapInArrow(count, "f long, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()
    total = table.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    in_toxic, in_all = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = got.column("f").to_numpy()
    in_toxic[at], in_all[at] = got.column("t").to_numpy(), got.column("n").to_numpy()
    chosen = term_features(groups)
    if total[0]:
        chosen = np.union1d(chosen, telling(in_toxic, in_all, total[0], int(total[1])))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([np.intersect1d(np.frombuffer(b, "<i4"), chosen).astype("<i4").tobytes() for b in batch.column(c).to_pylist()], pa.binary()) for c in ("before", "after")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), *columns], ["_id", "_label", "before", "after"])

    rows = table.mapInArrow(narrow, table.schema).collect()
    discard(table)
    rows.sort(key=lambda r: (str(r["_id"]), r["_label"], bytes(r["before"])))
    plain = [(np.frombuffer(r["before"], "<i4").astype(np.int64), np.frombuffer(r["after"], "<i4").astype(np.int64), int(r["_label"])) for r in rows]
    return fit(plain, chosen=chosen, counterfactual=counterfactual)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    max_train_rows: int = 8000,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    counterfactual: float = 1.0,
) -> DataFrame:
    """Score every text with a model fitted on labels outside the held-out fold.

    Returns one row per document: doc_id, held_out, score, predicted.  Rows whose
    crc32(doc_id as text) mod folds is 0 are held out.  The model is fitted on at most
    max_train_rows labelled rows, those least in a hash of their doc_id, and the driver gets only
    chosen features of them (at most 4096 and those of the terms), however long the texts.
    counterfactual weighs the penalty on swaps.

    * Null labels are ignored; a doc_id labelled twice trains with both labels.  Without labels of
      both kinds the score is constant.
    * A null or empty text has the score of the model's bias.  A null doc_id is not held out, is
      scored, and never trains.
    * Equal texts get equal scores.  An empty table gives an empty result.
    * Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    usable = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out)
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_train_rows)
    # max_train_rows rows of two numbers
    model = fitted(docs.join(F.broadcast(sample), "_id").select("_id", "_label", "text"), groups, counterfactual)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            scores = shared.value.scores(W.split(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores)], ["_id", "score"])

    scored = docs.mapInArrow(score, f"_id {docs.schema['_id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("_id").alias(doc_id), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def is_held_out(doc_id: object, folds: int = 5, remainder: int = 0) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == remainder


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
