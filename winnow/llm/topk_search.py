"""Exact top-k search: BM25 by block-max WAND over an inverted index per shard, merged exactly.

Document frequencies, the number of documents and their mean length are global, so a document's
score does not depend on its shard.  The index is written once: a shard holds the posting lists of
some thousand documents, which are laid side by side by their commonest word and length, so that
blocks of neighbours have low maxima.  Against a shard a query goes through these steps, each for
all its lists at once instead of cursor by cursor:

1. Block maxima of its lists are summed per block; blocks that cannot reach the threshold are skipped.
2. Pivot: with the lists in order of their maxima for each posting, those that even together stay
   below the threshold give no document; documents come only from the others, and only from blocks
   left.  So the longest lists are not walked.
3. A document is scored on if what it has so far, and the block maxima of the other lists, can
   reach the threshold: first in the shorter lists, in blocks that still hold such documents, then,
   if it still can, in the longest, which are kept as rows over all documents.

The threshold is the k-th best score known: shards come in rounds that grow eightfold, so all but
the first start from the k-th best of the rounds before, and improve on it by their own hits.  With
a threshold queries go through the same steps together: short lists are walked; where a block's
best so far and the block maxima of the longest lists cannot reach the threshold it is skipped; in
the others the longest lists come in as a product of matrices in 32 bits, and documents within its
error of the threshold are then scored exactly.

Impacts are rounded to multiples of 2**-38, so that sums up to 32768 are exact in any order, bounds
are never too low, and equal texts get equal scores in all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .gru import one_thread
from .tables import discard, materialize, read

K1, B = 1.2, 0.75
#: Each round has so many times the documents of all before it, as far as there are.
GROWTH = 7
#: Documents of a block; blocks scored whole for a first threshold, besides those that hold k documents; the unit of impacts.
BLOCK, LEAD, UNIT = 32, 6, 2.0**-38
#: A list with at least so large a part of a shard's documents is kept as a row over all of them.
DENSE = 32
#: Postings in each of its blocks up to which a list is walked whole.
SHORT = 3
#: Queries that go together: documents of their blocks, cells of their sums, postings walked at once.
GROUP, CELLS, STEP = 128, 1 << 21, 1 << 16
#: Queries that are worth a task of their own against a shard.
PART = 512


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end, one range after the other."""
    sizes = ends - starts
    stops = np.cumsum(sizes, dtype=np.int64)
    total = int(stops[-1]) if len(stops) else 0
    kind = starts.dtype if total < 1 << 31 else np.int64
    out = np.repeat((starts - stops + sizes).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def lists_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the texts in their shard, their words' number in it, the words, and postings: term, document, times."""
    words = W.split(texts, lower=True)
    n = max(len(words.counts), 1)
    keys, times = np.unique(words.codes * n + np.repeat(np.arange(len(words.counts)), words.counts), return_counts=True)
    term, doc = keys // n, keys % n
    most, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(most, doc, times)
    top = times == most[doc]
    common[doc[top]] = term[top]
    order = np.lexsort((words.counts, common[: len(words.counts)]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(len(order))
    again = np.argsort(term * n + place[doc])
    return order, words.counts[order], words, term[again], place[doc][again], times[again]


class Shard:
    """Posting lists with block maxima of the words that queries ask for.

    Lists that hold at least one in DENSE documents are kept as plain rows over all documents, and
    so are their block maxima.
    """

    def __init__(self, asked: np.ndarray, first: np.ndarray, doc: np.ndarray, times: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> None:
        """asked: of each list its number among the asked words, or -1; first: where its postings begin."""
        known = np.flatnonzero(asked >= 0)
        at = ranges(first[known], first[known + 1])
        sizes = (first[1:] - first[:-1])[known]
        term, doc, tf = np.repeat(np.arange(len(known)), sizes), doc[at].astype(np.int64), times[at].astype(np.float64)
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        impact = np.repeat(idf[asked[known]], sizes) * tf * (K1 + 1) / (tf + norm[doc])
        impact = np.maximum(np.round(impact / UNIT), 1) * UNIT
        self.row = np.full(len(idf), -1, np.int64)
        self.row[asked[known]] = np.arange(len(known))
        self.texts, self.blocks = len(lengths), -(-len(lengths) // BLOCK)
        self.doc, self.impact = doc.astype(np.int32), impact
        # the blocks of each list: their first posting, their number and maximum
        cell = term * max(self.blocks, 1) + doc // BLOCK
        cut = np.flatnonzero(np.diff(cell, prepend=-1))
        self.block_post = np.append(cut, len(cell)).astype(np.int32)
        self.block_of = (doc[cut] // BLOCK).astype(np.int32)
        self.block_max = np.maximum.reduceat(impact, cut) if len(cut) else np.empty(0)
        self.block_first = np.searchsorted(term[cut], np.arange(len(known) + 1)).astype(np.int32)
        starts = np.searchsorted(term, np.arange(len(known)))
        self.list_max = np.maximum.reduceat(impact, starts) if len(starts) else np.empty(0)
        self.list_cost = self.list_max / np.maximum(sizes, 1)
        wide = np.flatnonzero(sizes * DENSE >= self.texts)
        self.wide = np.full(len(known), -1, np.int64)
        self.wide[wide] = np.arange(len(wide))
        padded = np.zeros((len(wide), self.blocks * BLOCK))
        self.rows = padded[:, : self.texts]
        own = self.wide[term] >= 0
        self.rows[self.wide[term[own]], doc[own]] = impact[own]
        self.row_max = padded.reshape(len(wide), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((len(wide), 0))
        self.scored = self.walked = 0
        self.start = np.append(starts, len(term))
        self.group = 0

    def _lay(self) -> None:
        """For queries that go together: the rows by blocks of GROUP documents."""
        self.group = max(1, min(GROUP, self.texts))
        groups = -(-self.texts // self.group)
        self.dense = np.zeros((groups, len(self.rows), self.group), np.float32)
        for g in range(groups):
            own = self.rows[:, g * self.group : (g + 1) * self.group]
            self.dense[g, :, : own.shape[1]] = own
        self.dense_max = self.dense.max(axis=2).T

    def _parted(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists that are walked, and the rows of the others."""
        row = self.wide[terms]
        return terms[row < 0], row[row >= 0]

    def _upper(self, lists: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Summed block maxima, for each block."""
        at = ranges(self.block_first[lists], self.block_first[lists + 1])
        return np.bincount(self.block_of[at], weights=self.block_max[at], minlength=self.blocks) + self.row_max[rows].sum(axis=0)

    def _walk(self, lists: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Sums over the postings of some lists, for each document; only those in live blocks are sure to count.

        Lists of few postings in a block are walked whole: to skip costs as much as to read.
        """
        first, last = self.block_first[lists], self.block_first[lists + 1]
        start, end = self.block_post[first], self.block_post[last]
        long = end - start > SHORT * (last - first)
        at = ranges(first[long], last[long])
        at = at[live[self.block_of[at]]]
        post = ranges(np.concatenate([start[~long], self.block_post[at]]), np.concatenate([end[~long], self.block_post[at + 1]]))
        self.walked += len(post)
        return np.bincount(self.doc[post], weights=self.impact[post], minlength=self.texts)

    def _cells(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        self.walked += len(rows) * len(docs)
        return self.rows[rows[:, None], docs].sum(axis=0)

    def top(self, asked: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, among them all that are of the k best and reach the bound; score 0 is no hit."""
        terms = self.row[asked]
        terms = terms[terms >= 0]
        lists, rows = self._parted(terms)
        upper = self._upper(lists, rows)
        live = (upper >= bound) & (upper > 0)
        docs, scores = np.empty(0, np.int64), np.empty(0)
        if bound <= 0 and live.any():  # the blocks of the highest bounds give a threshold
            lead = np.argsort(-upper, kind="stable")[: -(-k // BLOCK) + LEAD]
            docs = ranges(lead * BLOCK, np.minimum((lead + 1) * BLOCK, self.texts))
            own = np.zeros(self.blocks, bool)
            own[lead] = True
            scores = self._walk(lists, own)[docs] + self._cells(rows, docs)
            self.scored += len(docs)
            if len(docs) >= k:
                bound = float(np.partition(scores, len(scores) - k)[len(scores) - k])
            live &= upper >= bound
            live[lead] = False
        if live.any():
            order = np.argsort(self.list_cost[terms], kind="stable")
            below = int(np.searchsorted(np.cumsum(self.list_max[terms[order]]), bound, side="left"))
            (lists, rows), (pivots, pivot_rows) = self._parted(terms[order[:below]]), self._parted(terms[order[below:]])
            part = self._walk(pivots, live)
            if len(pivot_rows):
                self.walked += len(pivot_rows) * self.texts
                part = part + self.rows[pivot_rows].sum(axis=0)
            some = np.flatnonzero(part)
            if not live.all():
                some = some[live[some // BLOCK]]
            some = some[part[some] + self._upper(lists, rows)[some // BLOCK] >= bound]
            self.scored += len(some)
            live = np.zeros(self.blocks, bool)
            live[some // BLOCK] = True
            part = part[some] + self._walk(lists, live)[some]
            can = part + self.row_max[rows].sum(axis=0)[some // BLOCK] >= bound
            some, part = some[can], part[can]
            docs, scores = np.concatenate([docs, some]), np.concatenate([scores, part + self._cells(rows, some)])
        good = (scores >= bound) & (scores > 0)
        return docs[good], scores[good]

    def top_together(self, codes: np.ndarray, starts: np.ndarray, some: np.ndarray, k: int, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """What top gives, for those queries of some that find any; query q asks for codes[starts[q]:starts[q + 1]] from bounds[q] > 0 on."""
        if not self.texts or not len(self.wide):
            return
        if not self.group:
            self._lay()
        most = max(1, CELLS // max(len(self.dense) * self.group, len(self.rows)))
        for lo in range(0, len(some), most):
            own = some[lo : lo + most]
            terms = self.row[codes[ranges(starts[own], starts[own + 1])]]
            owner = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])[terms >= 0]
            for q, docs, scores in self._together(terms[terms >= 0], owner, k, bounds[own]):
                yield int(own[q]), docs, scores

    def _together(self, terms: np.ndarray, owner: np.ndarray, k: int, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        many, groups, width = len(bounds), len(self.dense), len(self.dense) * self.group
        # each sum of 32 bits is within this share of the exact one: all impacts are positive
        error = (np.bincount(owner, minlength=many) + 8) * 2.0**-23
        least = bounds * np.maximum(1 - error, 0)
        row = self.wide[terms]
        asked = np.zeros((many, len(self.rows)), np.float32)
        asked[owner[row >= 0], row[row >= 0]] = 1
        # the short lists, for some queries at a time
        short, of = terms[row < 0], owner[row < 0]
        sizes = self.start[short + 1] - self.start[short]
        self.walked += int(sizes.sum())
        sums = np.empty((many, width))
        step = np.cumsum(np.bincount(of, weights=sizes, minlength=many)) // STEP
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), many]
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = np.searchsorted(of, [a, b])
            post = ranges(self.start[short[lo:hi]], self.start[short[lo:hi] + 1])
            cell = np.repeat((of[lo:hi] - a) * width, sizes[lo:hi])
            cell += self.doc[post]
            sums[a:b] = np.bincount(cell, weights=self.impact[post], minlength=(b - a) * width).reshape(b - a, width)
        # the rows of the others, in blocks that can reach the threshold
        live = sums.reshape(many, groups, self.group).max(axis=2) + asked @ self.dense_max >= least[:, None]
        hits = []
        for g in np.flatnonzero(live.any(axis=0)).tolist():
            some = np.flatnonzero(live[:, g])
            self.scored += len(some) * self.group
            near = asked[some] @ self.dense[g] + sums[some, g * self.group : (g + 1) * self.group]
            at, docs = np.nonzero(near >= least[some, None])
            hits.append((some[at], docs + g * self.group, near[at, docs]))
        if not hits:
            return
        found, docs, near = (np.concatenate(x) for x in zip(*hits))
        real = docs < self.texts
        order = np.flatnonzero(real)[np.argsort(found[real], kind="stable")]
        found, docs, near = found[order], docs[order], near[order]
        ends, row_ends, rows = np.searchsorted(found, np.arange(many + 1)), np.searchsorted(owner[row >= 0], np.arange(many + 1)), row[row >= 0]
        for q in np.unique(found).tolist():
            own, close = docs[ends[q] : ends[q + 1]], near[ends[q] : ends[q + 1]]
            if len(own) > k:
                own = own[close >= np.partition(close, len(own) - k)[len(own) - k] * (1 - 2 * error[q])]
            scores = sums[q, own] + self._cells(rows[row_ends[q] : row_ends[q + 1]], own)
            good = (scores >= bounds[q]) & (scores > 0)
            if good.any():
                yield q, own[good], scores[good]


def best_of(docs: np.ndarray, scores: np.ndarray, k: int, place: np.ndarray) -> np.ndarray:
    """Positions of the k best by score, then place."""
    return np.lexsort((place[docs], -scores))[:k]


def search(
    documents: DataFrame,
    queries: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = 10,
    shard_rows: int = 8192,
    shard_bytes: int = 32 << 20,
    block_terms: int = 4 << 20,
) -> DataFrame:
    """The k best documents of each query by BM25, exactly.

    A query is a row of queries (same columns as documents); its words are all distinct ones of its
    whole text.  Shards have at most shard_rows documents and about shard_bytes bytes of text, or
    one longer text.  Queries go in blocks of about block_terms words, or one longer query, that
    are sent to all shards; texts are read once for each round of the index, not for each block.

    Returns query_id, rank, doc_id, score.  Ties go to the lesser doc_id; fewer than k rows if
    fewer documents share a word.

    * Null, empty or blank texts have no words: as queries they return nothing, as documents they
      are never found, but count in the number and mean length.
    * Repeated rows are documents of their own; rows with a null doc_id are neither.  Queries that
      repeat a doc_id are one query of all their words, each counted once.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession

    def cleaned(df: DataFrame) -> DataFrame:
        out = df.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        return out.filter(F.col("_id").isNotNull())

    docs, asked = cleaned(documents), cleaned(queries)
    kind = docs.schema["_id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            words = W.split(batch.column("text"), lower=True)
            many = max(len(words.vocabulary), 1)
            pairs = np.unique(np.repeat(np.arange(batch.num_rows), words.counts) * many + words.codes)
            word = words.vocabulary.take(pa.array(pairs % many)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(pairs // many)), word], ["_query", "word"])

    # the index: a row for each shard, with its round
    n = docs.count()
    ends = [min(1.0, shard_rows / max(n, 1))]
    while ends[-1] < 1:
        ends.append(min(1.0, ends[-1] * (GROWTH + 1)))
    mark = F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    layout = f"round int, ids array<{kind}>, lengths binary, words array<string>, first binary, docs binary, times binary"

    def indexed(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.steps(_gathered(batches, shard_rows, shard_bytes), size=shard_bytes):
                order, lengths, words, term, doc, times = lists_of(batch.column("text"))
                first = np.searchsorted(term, np.arange(len(words.vocabulary) + 1))
                ids = batch.column("_id").take(pa.array(order))
                names = words.vocabulary.cast(pa.string())
                blobs = [x.tobytes() for x in (lengths.astype("<i4"), first.astype("<i4"), doc.astype("<u4"), times.astype("<u4"))]
                columns = [pa.array([number], pa.int32()), _listed(ids), pa.array([blobs[0]]), _listed(names), *[pa.array([b]) for b in blobs[1:]]]
                yield pa.RecordBatch.from_arrays(columns, ["round", "ids", "lengths", "words", "first", "docs", "times"])

        return run

    parts = []
    for r, end in enumerate(ends):
        own = docs.filter((mark >= (ends[r - 1] if r else 0.0)) & (mark < end))
        if r < len(ends) - 1 or not r:  # a small share of all, in whole shards
            own = own.repartition(max(1, round(n * (end - (ends[r - 1] if r else 0.0)) / shard_rows)))
        parts.append(own.mapInArrow(indexed(r), layout))
    index = [materialize(part) for part in parts]
    whole = index[0]
    for part in index[1:]:
        whole = whole.union(part)
    shards = [part.count() for part in index]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                first, lengths = (np.frombuffer(one.column(c)[0].as_buffer(), "<i4") for c in ("first", "lengths"))
                words = pa.concat_arrays([one.column("words").flatten(), pa.array([" "])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(np.diff(first), lengths.sum(dtype=np.int64)), pa.int64())], ["word", "df"])
        W.release()

    # no word is a blank, so that stands for all words of all documents
    counts = whole.select("words", "first", "lengths").mapInArrow(frequencies, "word string, df long")
    counts = materialize(counts.groupBy("word").agg(F.sum("df").alias("df")))
    mean = (counts.filter("word = ' '").agg(F.sum("df")).first()[0] or 0) / max(n, 1)
    chosen = asked.mapInArrow(terms, f"_query {kind}, word string").distinct().join(counts, "word")
    chosen = materialize(chosen.groupBy("_query").agg(F.collect_list("word").alias("words"), F.collect_list("df").alias("dfs")))
    blocks = max(1, -(-(chosen.agg(F.sum(F.size("words"))).first()[0] or 0) // block_terms))
    chosen = chosen.withColumn("_block", F.pmod(F.xxhash64("_query"), F.lit(blocks)))

    schema = f"query_id {kind}, _id {kind}, score double"
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_id"))

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", place).filter(F.col("rank") <= k)

    found = []
    for block in range(blocks):
        questions = chosen.filter(F.col("_block") == block).toArrow().combine_chunks()
        if not questions.num_rows:
            continue
        lists = questions.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int32)
        df = np.zeros(len(coded.dictionary))
        df[codes] = questions.column("dfs").combine_chunks().flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        queries_of = questions.column("_query").combine_chunks()
        shared = spark.sparkContext.broadcast((queries_of, coded.dictionary, codes, starts, np.log(1 + (n - df + 0.5) / (df + 0.5))))
        row_of = {q: i for i, q in enumerate(queries_of.to_pylist())}
        hits = None
        for r in range(len(ends)):
            bound, bound_id = np.zeros(len(row_of)), [None] * len(row_of)
            for last in best(hits).filter(F.col("rank") == k).collect() if hits is not None else []:
                bound[row_of[last["query_id"]]], bound_id[row_of[last["query_id"]]] = last["score"], last["_id"]
            known = spark.sparkContext.broadcast((bound, bound_id))

            # few shards are searched by several tasks, each for a part of the queries
            tasks = spark.sparkContext.defaultParallelism
            deal = max(1, min(-(-tasks // max(shards[r], 1)), len(row_of) // PART))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, known=known, deal=deal) -> Iterator[pa.RecordBatch]:
                queries_of, asked_words, codes, starts, idf = shared.value
                bound, bound_id = known.value
                one_thread()
                for batch in batches:
                    for row in range(batch.num_rows):
                        one = batch.slice(row, 1)
                        lengths, first, doc, times = (np.frombuffer(one.column(c)[0].as_buffer(), t) for c, t in (("lengths", "<i4"), ("first", "<i4"), ("docs", "<u4"), ("times", "<u4")))
                        numbers = pc.index_in(one.column("words").flatten(), asked_words).fill_null(-1).to_numpy(zero_copy_only=False)
                        shard = Shard(numbers.astype(np.int64), first.astype(np.int64), doc, times, lengths, idf, mean)
                        ids = one.column("ids").flatten()
                        plain = ids.to_pylist()
                        in_order = np.empty(len(plain), np.int64)
                        in_order[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
                        q_out, d_out, s_out = [], [], []
                        mine = np.arange(one.column("part")[0].as_py(), len(bound), deal)
                        alone = ((q, *shard.top(codes[starts[q] : starts[q + 1]], k, 0.0)) for q in mine[bound[mine] <= 0].tolist())
                        for q, d, s in chain(alone, shard.top_together(codes, starts, mine[bound[mine] > 0], k, bound)):
                            if len(d) and bound[q] > 0:
                                ties = np.flatnonzero(s == bound[q])
                                if len(ties):
                                    late = [t for t in ties.tolist() if not plain[d[t]] < bound_id[q]]
                                    d, s = np.delete(d, late), np.delete(s, late)
                            if len(d):
                                top = best_of(d, s, k, in_order)
                                q_out.append(np.full(len(top), q))
                                d_out.append(d[top])
                                s_out.append(s[top])
                        if q_out:
                            q, d, s = (np.concatenate(x) for x in (q_out, d_out, s_out))
                            yield pa.RecordBatch.from_arrays([queries_of.take(pa.array(q)), ids.take(pa.array(d)), pa.array(s)], ["query_id", "_id", "score"])
                W.release()

            more = index[r].withColumn("part", F.lit(0))
            for part in range(1, deal):
                more = more.union(index[r].withColumn("part", F.lit(part)))
            more = more.mapInArrow(run, schema)
            before, hits = hits, materialize(more if hits is None else best(hits).drop("rank").union(more))
            if before is not None:
                discard(before)
            known.unpersist()
        found.append(best(hits))
        shared.unpersist()
    discard(*index, counts)
    out = spark.createDataFrame([], f"{schema}, rank int") if not found else found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("_id").alias(doc_id), "score")


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and, but for the last of each, about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            if held and (sum(b.num_rows for b in held) + part.num_rows > rows or sum(b.nbytes for b in held) > size):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every fiftieth document; scores with six decimals, ranks by the whole score."""
    docs = read(spark, sf_dir, "documents")
    return search(docs, docs.filter(F.col("doc_id") % 50 == 0)).withColumn("score", F.round("score", 6))


OP4_SQL = f"""
WITH docs AS (SELECT doc_id, {W.FOLDED_WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
sizes AS (SELECT doc_id, len(w) AS n FROM docs),
total AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM sizes),
postings AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM docs) GROUP BY ALL),
idf AS (SELECT word, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, total GROUP BY word, docs),
impacts AS (
  SELECT doc_id, word, greatest(round(idf * tf * {K1 + 1!r}::DOUBLE / (tf + {K1!r}::DOUBLE * (1 - {B!r}::DOUBLE + {B!r}::DOUBLE * n / mean)) * pow(2::DOUBLE, 38)), 1) / pow(2::DOUBLE, 38) AS x
  FROM postings JOIN idf USING (word) JOIN sizes USING (doc_id), total),
scored AS (
  SELECT q.doc_id AS query_id, i.doc_id, sum(x) AS s
  FROM postings q JOIN impacts i USING (word) WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank, doc_id, round(s, 6) AS score FROM ranked WHERE rank <= 10
"""
