"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists.

The index is written once, a row for each shard of documents: for each term the documents that hold
it and how often.  Counts over the whole corpus make impacts comparable, so a document's score does
not depend on its shard.  Within a shard a query goes round its lists, each sorted by falling
impact, a few postings of each list at a time; every document met for the first time gets its whole
score at once by random look-ups in the forward index.  The threshold, the sum of the impacts last
seen in each list, bounds the score of all documents not met; the query stops as soon as it is
strictly below the k-th best score, so ties are all met.

Shards come in rounds that grow eightfold: all but the first start from the k-th best score of the
rounds before, which stops most of them early.  All scores are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import units as U
from . import words as W
from .tables import discard, materialize, read
from .topk_search import _gathered, _listed

#: Each round has so many times the documents of all before it, as far as there are.
GROWTH = 7
#: Postings of each list in a query's first step; each step takes twice as many as the one before.
STEP = 8
#: The term that stands for all terms of all documents in the table of counts, and the one for documents with a term.
ALL_TERMS, ALL_DOCS = " ", "  "
#: Characters that part terms: ASCII but for letters and digits.  A-Z become a-z.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split(texts: pa.Array) -> W.Words:
    """Terms of each text: maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    data, offsets = U.bytes_of(U.plain(texts))
    folded = U.binaries(np.frombuffer(data.tobytes().translate(_FOLDED), np.uint8), offsets)
    return W.split(folded.cast(pa.large_string()))


def quotients(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied with: 10^9 tf div (1000 tf + 8 m), m = 10 + 90 n N div L."""
    m = 10 + (90 * length * docs) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Shard:
    """Impact-sorted lists of the asked terms, and the forward index of the same postings."""

    def __init__(self, asked: np.ndarray, first: np.ndarray, doc: np.ndarray, times: np.ndarray, lengths: np.ndarray, weights: np.ndarray, docs: int, total: int) -> None:
        """asked: of each list its number among the asked terms, or -1; first: where its postings begin."""
        known = np.flatnonzero(asked >= 0)
        at = U.ranges(first[known], first[known + 1])
        sizes = (first[1:] - first[:-1])[known]
        number = np.repeat(np.arange(len(known)), sizes)
        own, tf = doc[at].astype(np.int64), times[at].astype(np.int64)
        impact = np.repeat(weights[asked[known]], sizes) * quotients(tf, lengths[own].astype(np.int64), docs, total)
        order = np.lexsort((own, -impact, number))
        self.doc, self.impact = own[order], impact[order]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.list_of = np.full(len(weights), -1, np.int64)
        self.list_of[asked[known]] = np.arange(len(known))
        # forward: the lists of each document and their impacts
        forward = np.argsort(own, kind="stable")
        self.term, self.score = number[forward], impact[forward]
        self.begins = np.searchsorted(own[forward], np.arange(len(lengths) + 1))
        self.texts = len(lengths)
        self.met = self.walked = 0

    def top(self, asked: np.ndarray, k: int, bound: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents with scores above 0 and not below bound; equal scores by place, and none without a place."""
        lists = self.list_of[asked]
        lists = lists[lists >= 0]
        begin, end = self.first[lists], self.first[lists + 1]
        mine = np.zeros(len(self.first) - 1, np.int64)
        mine[lists] = 1
        unseen = place >= 0
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step, kth = begin, STEP, max(bound, 1)
        while (depth < end).any():
            until = np.minimum(depth + step, end)
            post = U.ranges(depth, until)
            self.walked += len(post)
            new = np.unique(self.doc[post])
            new = new[unseen[new]]
            unseen[new] = False
            self.met += len(new)
            # random look-ups: the whole score of each new document
            lo, hi = self.begins[new], self.begins[new + 1]
            at = U.ranges(lo, hi)
            found = np.add.reduceat(self.score[at] * mine[self.term[at]], np.cumsum(hi - lo) - (hi - lo)) if len(new) else new
            good = found >= kth
            docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, found[good]])
            best = np.lexsort((place[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                kth = max(kth, int(scores[-1]))
            threshold = int(self.impact[until[until < end] - 1].sum())
            if threshold < kth:
                break
            depth, step = until, 2 * step
        return docs, scores


def search(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    k: int = 10,
    shard_rows: int = 8192,
    shard_bytes: int = 32 << 20,
    block_terms: int = 4 << 20,
) -> DataFrame:
    """The k best documents of each item, exactly; equal scores by ascending doc_id.

    Shards have at most shard_rows documents and about shard_bytes bytes of text, or one longer
    text.  Items go in blocks of about block_terms terms, or one longer item, that are sent to all
    shards; texts are read once, for the index.

    Returns item_id, rank, doc_id, score (above 0).

    * Null, empty or blank texts have no terms: as items they return nothing, as documents they are
      never found and do not count.
    * Repeated rows are documents of their own.  Rows with a null doc_id count in all sums and are
      never found; items with a null item_id are not asked.  Items that repeat an id are one item
      of all their terms, each counted once.
    * Texts are indexed whole, whatever their length.  An empty table gives an empty result.  Other
      columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("_item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("_item IS NOT NULL")
    kind, item_kind = docs.schema["_id"].dataType.simpleString(), asked.schema["_item"].dataType.simpleString()
    layout = f"ids array<{kind}>, lengths binary, words array<string>, first binary, docs binary, times binary"

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(_gathered(batches, shard_rows, shard_bytes), size=shard_bytes):
            words = split(batch.column("text"))
            n = max(batch.num_rows, 1)
            keys, times = np.unique(words.codes * n + np.repeat(np.arange(batch.num_rows), words.counts), return_counts=True)
            first = np.searchsorted(keys // n, np.arange(len(words.vocabulary) + 1))
            blobs = [x.tobytes() for x in (words.counts.astype("<i8"), first.astype("<i8"), (keys % n).astype("<i4"), times.astype("<i4"))]
            columns = [_listed(batch.column("_id")), pa.array(blobs[:1]), _listed(words.vocabulary.cast(pa.string())), *[pa.array([b]) for b in blobs[1:]]]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "words", "first", "docs", "times"])

    index = materialize(docs.mapInArrow(indexed, layout).withColumn("mark", F.rand(7)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                first, lengths = (np.frombuffer(one.column(c)[0].as_buffer(), "<i8") for c in ("first", "lengths"))
                words = pa.concat_arrays([one.column("words").flatten(), pa.array([ALL_TERMS, ALL_DOCS])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([np.diff(first), [lengths.sum(), (lengths > 0).sum()]]), pa.int64())], ["word", "df"])
        W.release()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            words = split(batch.column("text"))
            many = max(len(words.vocabulary), 1)
            pairs = np.unique(np.repeat(np.arange(batch.num_rows), words.counts) * many + words.codes)
            yield pa.RecordBatch.from_arrays([batch.column("_item").take(pa.array(pairs // many)), words.vocabulary.take(pa.array(pairs % many)).cast(pa.string())], ["_item", "word"])

    counts = materialize(index.select("words", "first", "lengths").mapInArrow(frequencies, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")))
    whole = {r.word: r.df for r in counts.filter(F.col("word").isin(ALL_TERMS, ALL_DOCS)).collect()}
    total, many_docs = int(whole.get(ALL_TERMS, 0)), int(whole.get(ALL_DOCS, 0))
    chosen = asked.mapInArrow(terms, f"_item {item_kind}, word string").distinct().join(counts, "word")
    chosen = materialize(chosen.groupBy("_item").agg(F.collect_list("word").alias("words"), F.collect_list("df").alias("dfs")))
    blocks = max(1, -(-(chosen.agg(F.sum(F.size("words"))).first()[0] or 0) // block_terms))
    shards = index.count()
    ends = [min(1.0, 1 / max(shards, 1))]
    while ends[-1] < 1:
        ends.append(min(1.0, ends[-1] * (GROWTH + 1)))

    schema = f"item_id {item_kind}, _id {kind}, score long"
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "_id"))

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", place).filter(F.col("rank") <= k)

    found = []
    for block in range(blocks):
        questions = chosen.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not questions.num_rows:
            continue
        lists = questions.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        df = np.zeros(len(coded.dictionary), np.int64)
        df[codes] = questions.column("dfs").combine_chunks().flatten().to_numpy()
        weights = np.array([weight(many_docs, int(d)) for d in df], np.int64)
        shared = spark.sparkContext.broadcast((questions.column("_item").combine_chunks(), coded.dictionary, codes, lists.offsets.to_numpy().astype(np.int64), weights))
        hits = None
        for r, end in enumerate(ends):
            numbers = {v: n for n, v in enumerate(questions.column("_item").to_pylist())}
            bound = np.zeros(len(numbers), np.int64)
            if hits is not None:
                for row in best(hits).filter(F.col("rank") == k).select("item_id", "score").toLocalIterator():
                    bound[numbers[row[0]]] = row[1]
            known = spark.sparkContext.broadcast(bound)

            def run(batches: Iterator[pa.RecordBatch], shared=shared, known=known) -> Iterator[pa.RecordBatch]:
                item_of, asked_words, codes, starts, weights = shared.value
                bound = known.value
                for batch in batches:
                    for row in range(batch.num_rows):
                        one = batch.slice(row, 1)
                        lengths, first, doc, times = (np.frombuffer(one.column(c)[0].as_buffer(), t) for c, t in (("lengths", "<i8"), ("first", "<i8"), ("docs", "<i4"), ("times", "<i4")))
                        names = pc.index_in(one.column("words").flatten(), asked_words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                        shard = Shard(names, first, doc, times, lengths, weights, many_docs, total)
                        ids = one.column("ids").flatten()
                        in_order = np.empty(len(ids), np.int64)
                        in_order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                        in_order[pc.is_null(ids).to_numpy(zero_copy_only=False)] = -1
                        out = []
                        for q in range(len(starts) - 1):
                            d, s = shard.top(codes[starts[q] : starts[q + 1]], k, int(bound[q]), in_order)
                            if len(d):
                                out.append((np.full(len(d), q), d, s))
                        if out:
                            q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
                            yield pa.RecordBatch.from_arrays([item_of.take(pa.array(q)), ids.take(pa.array(d)), pa.array(s)], ["item_id", "_id", "score"])
                W.release()

            own = index.filter((F.col("mark") >= (ends[r - 1] if r else 0.0)) & (F.col("mark") < end))
            more = own.drop("mark").mapInArrow(run, schema)
            before, hits = hits, materialize(more if hits is None else best(hits).drop("rank").union(more))
            if before is not None:
                discard(before)
            known.unpersist()
        found.append(best(hits))
        shared.unpersist()
    discard(index, counts, chosen)
    out = spark.createDataFrame([], f"{schema}, rank int") if not found else found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.select(F.col("item_id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(doc_id), "score")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
sizes AS (SELECT row, doc_id, len(t)::BIGINT AS n FROM docs WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
postings AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, n_docs),
scored AS (
  SELECT a.item_id, s.row, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN postings p USING (term) JOIN weights USING (term) JOIN sizes s USING (row), total WHERE s.doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
