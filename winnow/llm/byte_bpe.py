"""Byte-level BPE: long texts in overlapping chunks that are stitched where their pre-tokens meet again.

A text of more than one chunk is cut into chunks that overlap.  Each chunk is pre-tokenised for
itself, wherever it happens to run.  A chunk that begins within a pre-token has wrong borders at
first; but the pattern looks only forward, so from the first border on that two neighbours have in
common in their overlap, the later chunk's pre-tokens are those of the text.  There the text is cut
into pieces, which are encoded in parallel and whose ids are joined.  Neighbours without a common
border (a run of one character class that is longer than the overlap) become one chunk, which is
pre-tokenised again, until all meet.  Equal long texts are encoded once.

Decoding concatenates the bytes of the ids; those of a part of a text need not be valid UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import units as U
from . import words as W
from .tables import carried, discard, materialize, read, uncarried

#: Characters of a chunk that are its own, and those that it shares with the next.
CHUNK, OVERLAP = 32768, 512
#: So far from where a chunk was cut off a border does not depend on what follows: a contraction has three characters.
MARGIN = 8
#: Characters from which a unit is pre-tokenised here: the tokenizer's own pattern engine overflows its stack on far longer ones.
LONG_UNIT = 1 << 16


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteTokenizer:
    """Ids of whole texts from a file of ranks and a pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory = U.Memory(self._alone)
        self.size = max(ranks.values()) + 1
        tokens: list[bytes | None] = [None] * self.size
        for token, k in ranks.items():
            tokens[k] = token
        self.tokens = pa.array(tokens, pa.large_binary())

    def _unit(self, unit: str) -> list[int]:
        if len(unit) < LONG_UNIT:
            return self.model.encode_ordinary(unit)
        return [k for m in self.pattern.finditer(unit) for k in self.model._encode_single_piece(m.group())]

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._unit(u) for u in units]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((k for x in ids for k in x), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text; a null text is empty."""
        flat, starts = U.encoded(self.memory, *U.cut(U.plain(texts)))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of each list of ids; a null list is empty."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten()
        if len(flat) and not (0 <= pc.min(flat).as_py() and pc.max(flat).as_py() < self.size):
            raise ValueError("an id is outside the vocabulary")
        tokens = self.tokens.take(flat)
        if tokens.null_count:
            raise ValueError("an id has no token")
        data, offsets = U.bytes_of(tokens)
        return U.binaries(data, offsets[np.concatenate([[0], np.cumsum(sizes)])]).cast(pa.binary())

    def borders(self, text: str) -> list[int]:
        """Ends of pre-tokens whose last character is no white space: what lies between two of them is encoded alone."""
        return [m.end() for m in self.pattern.finditer(text) if not m.group()[-1].isspace()]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _pieces(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, list[DataFrame]]:
    """Ids of the pieces of long texts: _key, first (where the piece begins), ids; and tables to discard later."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "start", "own", "last", "chunk"]
        for batch in W.steps(batches):
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = [0, *range(chunk, len(text) - overlap, chunk)]
                own = [*([chunk] * (len(starts) - 1)), len(text) - starts[-1]]
                for lo in range(0, len(starts), 64):
                    some, sizes = starts[lo : lo + 64], own[lo : lo + 64]
                    parts = [text[s : s + n + overlap] for s, n in zip(some, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([key] * len(some), some, sizes, [s == starts[-1] for s in some], parts)], names)

    def pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_borders = tokenizer(path, pattern).borders
        for batch in W.steps(batches, "chunk"):
            left, right = [], []
            for start, own, last, text in zip(*(batch.column(c).to_pylist() for c in ("start", "own", "last", "chunk")), strict=True):
                ends = own_borders(text)
                left.append([start + e for e in ends if e <= overlap] if start else [])
                right.append([] if last else [start + e for e in ends if own <= e <= len(text) - MARGIN])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], [*batch.schema.names, "left", "right"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path, pattern)
        for batch in W.steps(batches, "piece"):
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("first"), model.encode(batch.column("piece"))], ["_key", "first", "ids"])

    schema = "_key string, start long, own long, last boolean, chunk string"
    chunks = texts.mapInArrow(cut, schema).repartition("_key", "start")
    order = Window.partitionBy("_key").orderBy("start")
    settled, used = None, []
    while True:
        chunks = materialize(chunks.mapInArrow(pretokenised, f"{schema}, left array<long>, right array<long>"))
        meet = F.array_min(F.array_intersect(F.lag("right").over(order), "left"))
        seams = chunks.select("_key", "start", F.when(F.col("start") == 0, F.lit(0)).otherwise(meet).cast("long").alias("first"))
        seams = materialize(seams)
        used += [chunks, seams]
        open_texts = seams.filter("first IS NULL").select("_key").distinct()
        some_open = not open_texts.isEmpty()
        ends = seams.withColumn("stop", F.lead("first").over(order))
        whole = chunks.drop("left", "right").join(ends, ["_key", "start"])
        if some_open:
            whole = whole.join(open_texts, "_key", "left_anti")
        piece = F.substring("chunk", F.col("first") - F.col("start") + 1, F.coalesce(F.col("stop") - F.col("first"), F.lit(2**31 - 1)).cast("int"))
        found = whole.select("_key", "first", piece.alias("piece")).mapInArrow(encode_pieces, "_key string, first long, ids array<int>")
        settled = found if settled is None else settled.union(found)
        if not some_open:
            return settled, used
        # neighbours that do not meet become one chunk
        runs = seams.join(open_texts, "_key", "left_semi").withColumn("_run", F.count("first").over(order))
        parts = chunks.drop("left", "right").join(runs.drop("first"), ["_key", "start"])
        merged = parts.groupBy("_key", "_run").agg(
            F.min("start").alias("start"), F.sum("own").alias("own"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("start", "own", "chunk"))).alias("_parts")
        )
        text = F.expr("array_join(transform(_parts, (x, k) -> if(k = size(_parts) - 1, x.chunk, left(x.chunk, int(x.own)))), '')")
        chunks = merged.select("_key", "start", "own", "last", text.alias("chunk"))


def encode(
    documents: DataFrame,
    path: str,
    pattern: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Ids of each whole text, as if each match of pattern were encoded by the ranks in path alone.

    pattern looks only forward, its matches are white space or an optional blank and then no white
    space, and what it matches depends on at most MARGIN characters after a match.

    Returns one row per input row: doc_id, ids (array of int), then the carried columns.

    * A null or empty text has no ids.  Special tokens are plain text.
    * A text of any length is encoded whole: in chunks of so many characters, where it has more
      than chunk + overlap.
    * Rows are treated alone: repeated rows give equal rows; a null doc_id stays null.
    * An empty table gives an empty result.  Other columns are ignored unless carried.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), carried(carry).alias("_carry"))
    kind = docs.schema["_id"].dataType.simpleString()
    long = F.length("text") > chunk + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path, pattern)
        for batch in W.steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), model.encode(batch.column("text")), batch.column("_carry")], ["_id", "ids", "_carry"])

    short = docs.filter(~long).mapInArrow(run, f"_id {kind}, ids array<int>, _carry {docs.schema['_carry'].dataType.simpleString()}")
    keyed = docs.filter(long).withColumn("_key", F.sha2("text", 256))
    pieces, used = _pieces(keyed.groupBy("_key").agg(F.any_value("text").alias("text")), path, pattern, chunk, overlap)
    joined = pieces.groupBy("_key").agg(F.expr("flatten(transform(array_sort(collect_list(struct(first, ids))), x -> x.ids))").alias("ids"))
    joined = materialize(joined)
    discard(*used)
    out = short.union(keyed.join(joined, "_key").select("_id", "ids", "_carry"))
    return out.select(F.col("_id").alias(doc_id), "ids", *uncarried(carry))


def decode(encoded: DataFrame, path: str, pattern: str, *, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Bytes of each list of ids: bytes (binary), before it the carried columns.

    A null list or one without ids gives no bytes; an id that no token has is an error.  Repeated
    rows give equal rows, an empty table an empty result; other columns are ignored unless carried.
    """
    rows = encoded.select(carried(carry).alias("_carry"), F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column("_carry"), model.decode(part.column("ids"))], ["_carry", "bytes"])
        W.release()

    out = rows.mapInArrow(run, f"_carry {rows.schema['_carry'].dataType.simpleString()}, bytes binary")
    return out.select(*uncarried(carry), "bytes")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes that they decode to, as digests."""
    files = default_files()
    ids = encode(read(spark, sf_dir, "documents"), *files)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    counted = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"))
    return decode(counted, *files, carry=("doc_id", "n_tokens", "ids_sha256")).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")
    )
