"""Substring dedup: words inside passages that recur anywhere are removed, by phrase automata.

Confirm: every window of `window` words is assigned to its least k-word hash (the rightmost of
equals).  This anchor, and where windows lie around it, follow from the window's words alone, so
equal windows have equal anchors.  A run of windows with one anchor is a segment.  Anchors seen
once are done.  Segments seen twice are recurring passages as a whole.  The rest, around the
edges of passages, are settled window by window.  All counts are of 128-bit hashes and
pre-aggregate before each exchange.

Locate: documents are dealt to shards of bounded size.  A shard compiles one Aho-Corasick
automaton from the recurring passages that occur in it (each distinct passage once) and streams all its
documents through it; matches mark the words to remove.

Bitmaps of fixed size keep what is not needed out of the exchanges: segments whose anchor was seen
once, texts without open segments, windows seen once.  What they let through in error is dropped
by exact counts.  A segment is counted per shard before it meets others, so a passage that a third
of all documents hold sends one row from each shard.  Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .members import bitmap, may_hold
from .tables import discard, materialize, read

ANCHOR_WORDS = 8
_M1, _M2 = (int(m) for m in W.MULTIPLIERS)


class RangeHashes:
    """128-bit hashes of word ranges, from prefix sums of hash * multiplier ^ position."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.parts = []
        for m in (_M1, _M2):
            powers = np.full(len(hashes) + 1, m, np.uint64)
            inverse = np.full(len(hashes) + 1, pow(m, -1, 1 << 64), np.uint64)
            powers[0] = inverse[0] = 1
            powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
            self.parts.append((sums, inverse))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        lengths = (ends - starts).astype(np.uint64)
        return [W.signed(W.mixed((sums[ends] - sums[starts]) * inverse[starts] + lengths)) for sums, inverse in self.parts]


def segments(hashes: np.ndarray, starts: np.ndarray, window: int, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """Of all texts: owner, first window's start, number of windows and anchor hash of each segment."""
    empty = np.empty(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty, empty
    grams = W.gram_hashes(hashes, k)
    width = window - k + 1
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], width)[::-1]
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    begin = np.flatnonzero(owner[: len(hashes) - window + 1] == owner[window - 1 :])
    if not len(begin):
        return empty, empty, empty, empty
    anchor = np.empty(len(begin), np.int64)
    for lo in range(0, len(begin), 1 << 16):
        part = begin[lo : lo + (1 << 16)]
        anchor[lo : lo + len(part)] = part + width - 1 - view[part].argmin(axis=1)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[begin[1:]] != owner[begin[:-1]])])
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(begin)]]))
    return owner[begin[first]], begin[first], many, W.signed(grams[anchor[first]])


def _hashed(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    words = W.split(texts)
    return words, words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)


def _compressed(texts: pa.Array) -> pa.Array:
    compress = zstandard.ZstdCompressor(level=1).compress
    return pa.array([compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    decompress = zstandard.ZstdDecompressor().decompress
    return pa.array([decompress(z) for z in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def runs(starts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive starts, as (first, number)."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [(a, b) for a, b in out]


def remove_repeats(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 35,
    shard_rows: int = 512,
    shard_bytes: int = 4 << 20,
) -> DataFrame:
    """Remove each word covered by a window of words that also starts anywhere else.

    Returns one row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by
    one space).  Documents are dealt to shards of about shard_rows rows and at most about
    shard_bytes bytes of text, or one longer text.

    * A null, empty or blank text has no words; texts shorter than a window keep all words.
    * Windows are judged on the input.  Two occurrences within one document count, overlapping
      ones too; rows that repeat one document repeat each other and lose all their windows.
    * A null doc_id is kept as null and its text takes part.  Ties cannot occur.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.select("_id", F.xxhash64(F.lit(7), "_id", "text").alias("_row"), "text")
    kind = docs.schema["_id"].dataType.simpleString()
    total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-total[0] // shard_rows), -(-total[1] // shard_bytes))
    shard = F.pmod("_row", F.lit(shards)).cast("int")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            words, hashes = _hashed(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(segments(hashes, words.starts, window)[3])], ["_anchor"])

    again = docs.select("text").mapInArrow(anchors, "_anchor long").groupBy("_anchor").agg(F.count("*").alias("_c")).filter("_c > 1")
    known = bitmap(again, "_anchor")

    def details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            words, hashes = _hashed(batch.column("text"))
            owner, first, many, anchor = segments(hashes, words.starts, window)
            maybe = may_hold(known.value, anchor)
            owner, first, many, anchor = owner[maybe], first[maybe], many[maybe], anchor[maybe]
            s1, s2 = RangeHashes(hashes).of(first, first + many + window - 1)
            own = pa.array(owner)
            columns = [pa.array(anchor), pa.array(s1), pa.array(s2), batch.column("_id").take(own), batch.column("_row").take(own)]
            columns += [pa.array(first - words.starts[owner], pa.int32()), pa.array(many, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_anchor", "_s1", "_s2", "_id", "_row", "_first", "_many"])

    # segments by shard, and of all shards; segments of anchors seen once are still among them
    schema = f"_anchor long, _s1 long, _s2 long, _id {kind}, _row long, _first int, _many int"
    place = F.struct("_row", "_first", "_id", "_many")
    seen = docs.mapInArrow(details, schema).groupBy(shard.alias("_shard"), "_s1", "_s2")
    seen = materialize(seen.agg(F.min("_anchor").alias("_anchor"), F.count("*").alias("_c"), F.min(place).alias("_at")))
    distinct = seen.groupBy("_s1", "_s2").agg(F.min("_anchor").alias("_anchor"), F.sum("_c").alias("_c"), F.min("_at").alias("_at"))
    distinct = materialize(distinct)

    # windows of segments seen once, and of the segments that share their anchors
    open_anchors = distinct.groupBy("_anchor").agg(F.sum("_c").alias("_all"), F.min("_c").alias("_least"))
    open_anchors = materialize(open_anchors.filter("_all > 1 AND _least = 1").select("_anchor"))
    span = F.struct(F.col("_first").alias("first"), F.col("_many").alias("many"), F.col("_weight").cast("int").alias("weight"))
    lists = (
        distinct.join(open_anchors, "_anchor")
        .select("_at.*", F.least("_c", F.lit(2)).alias("_weight"))
        .groupBy("_id", "_row")
        .agg(F.collect_list(span).alias("list"))
        .toDF("_of", "_of_row", "list")
    )
    lists = materialize(lists)
    opened = bitmap(lists, "_of_row")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            some = batch.filter(pa.array(may_hold(opened.value, batch.column("_row").to_numpy())))
            yield pa.RecordBatch.from_arrays([some.column("_id"), some.column("_row"), _compressed(some.column("text"))], ["_id", "_row", "z"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, "z", W.STEP_BYTES // 2):
            words, hashes = _hashed(_plain(batch.column("z")))
            own, start, weight = [], [], []
            for k, spans in enumerate(batch.column("list").to_pylist()):
                for first, many, w in {(x["first"], x["many"], x["weight"]) for x in spans}:
                    own.append(np.full(many, k))
                    start.append(np.arange(first, first + many))
                    weight.append(np.full(many, w))
            owner = np.concatenate([np.empty(0, np.int64), *own])
            begin = np.concatenate([np.empty(0, np.int64), *start])
            at = begin + words.starts[owner]
            w1, w2 = RangeHashes(hashes).of(at, at + window)
            rows = pa.array(owner)
            columns = [pa.array(w1), pa.array(w2), batch.column("_id").take(rows), batch.column("_row").take(rows)]
            columns += [pa.array(begin, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *weight]), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_w1", "_w2", "_id", "_row", "_first", "_weight"])

    packed = f"_id {kind}, _row long, z binary"
    open_docs = docs.mapInArrow(chosen, packed).join(lists, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_of_row")))
    hashed = open_docs.select("_id", "_row", "z", "list").mapInArrow(windows, f"_w1 long, _w2 long, _id {kind}, _row long, _first int, _weight int")
    hashed = materialize(hashed)
    twice = materialize(hashed.groupBy("_w1", "_w2").agg(F.sum("_weight").alias("_c")).filter("_c > 1").select("_w1", "_w2"))
    recurring = bitmap(twice, "_w1")

    def maybe_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(recurring.value, batch.column("_w1").to_numpy())))

    single = hashed.filter("_weight = 1").drop("_weight")
    settled = single.mapInArrow(maybe_twice, single.schema).join(twice, ["_w1", "_w2"])
    settled = settled.select("_id", "_row", "_first", F.lit(1).alias("_many"), F.lit(True).alias("_single"))

    # one occurrence of each recurring segment in each shard
    whole = seen.join(distinct.filter("_c > 1").select("_s1", "_s2"), ["_s1", "_s2"])
    whole = whole.select("_at.*", F.lit(False).alias("_single")).select("_id", "_row", "_first", "_many", "_single")
    phrases = materialize(whole.union(settled).select(shard.alias("_shard"), "_id", "_row", "_first", "_many", "_single"))
    discard(seen, distinct, open_anchors, lists, hashed, twice)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), _compressed(batch.column("text"))], ["_id", "_row", "z"])

    def locate(texts: pa.Table, found: pa.Table) -> pa.Table:
        words = W.split(_plain(texts.column("z")))
        removed = np.zeros(len(words.codes), bool)
        if found.num_rows:
            at = {key: k for k, key in enumerate(zip(texts.column("_id").to_pylist(), texts.column("_row").to_pylist(), strict=True))}
            single: dict[int, list[int]] = {}
            spans: list[tuple[int, int]] = []
            for i, row, first, many, alone in zip(*(found.column(c).to_pylist() for c in ("_id", "_row", "_first", "_many", "_single")), strict=True):
                begin = first + int(words.starts[at[i, row]])
                if alone:
                    single.setdefault(at[i, row], []).append(begin)
                else:
                    spans.append((begin, many))
            spans += [r for begins in single.values() for r in runs(begins)]
            codes = words.codes.tolist()
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
            for begin, many in spans:
                automaton.add_word(tuple(codes[begin : begin + many + window - 1]))
            automaton.make_automaton()
            change = np.zeros(len(codes) + 1, np.int64)
            ends, lengths = [], []
            for lo, hi in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
                if hi - lo >= window:
                    for end, length in automaton.iter(tuple(codes[lo:hi])):
                        ends.append(lo + end + 1)
                        lengths.append(length)
            stop = np.array(ends, np.int64)
            np.add.at(change, stop - np.array(lengths, np.int64), 1)
            np.add.at(change, stop, -1)
            removed = np.cumsum(change[:-1]) > 0
        kept = np.flatnonzero(~removed)
        bounds = np.searchsorted(kept, words.starts)
        flat = words.vocabulary.take(pa.array(words.codes[kept]))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.cast(pa.string()))
        columns = {
            "_id": texts.column("_id"),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(words.counts - np.diff(bounds), pa.int64()),
            "kept_text": pc.binary_join(lists, " "),
        }
        return pa.table(columns)

    out = (
        docs.mapInArrow(carried, packed)
        .withColumn("_shard", shard)
        .groupBy("_shard")
        .cogroup(phrases.groupBy("_shard"))
        .applyInArrow(locate, f"_id {kind}, n_words long, n_removed long, kept_text string")
    )
    return out.withColumnRenamed("_id", doc_id)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH docs AS (SELECT doc_id, {W.WORDS_SQL} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM docs WHERE len(w) >= 35),
windows AS (SELECT doc_id, k, sha256(array_to_string(w[k:k + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM windows JOIN twice USING (h)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM placed a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
