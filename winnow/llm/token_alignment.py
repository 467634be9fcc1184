"""Alignment of two tokenizers by byte-owner arrays, and how often the corpus links their ids.

Both tokenizers cut the same bytes.  Each byte gets the number of the token that owns it, once for
each tokenizer (np.repeat over token lengths).  Consecutive distinct pairs of owners are the pairs
of tokens that overlap (links); where both owners change at once both tokenizers have a border, and
such cuts part the text into groups.

How many documents hold a pair of ids linked is counted over the corpus: shards of documents hold
their links against a table of their own distinct pairs, so only these, and not the links, are
exchanged with the counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units as U
from . import words as W
from .tables import discard, materialize, read

#: Bytes of text that are aligned at once; bytes whose owners are held at once; bytes and rows of text of a shard.
STEP_BYTES, OWNED = 2 << 20, 4 << 20
SHARD_BYTES, SHARD_ROWS = 16 << 20, 16384
#: Place of the first id in a pair's number.
HIGH = 32


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """Bytes by the letters that byte-level vocabularies write for them."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: byte-level BPE from a JSON file; special tokens in texts are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = _byte_letters()
        tokens: list[bytes] = [b""] * self.model.get_vocab_size()
        for token, k in self.model.get_vocab().items():
            tokens[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.tokens = pa.array(tokens, pa.large_binary())
        self.memory = U.Memory(self._alone)

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for k in range(0, len(units), 10_000):
            for e in self.model.encode_batch_fast(units[k : k + 10_000], add_special_tokens=False):
                ids = e.ids
                flat.append(np.array(ids, np.int32))
                sizes.append(len(ids))
        return np.concatenate(flat), np.array(sizes, np.int64)


class Pieces:
    """Tokenizer B: a sentencepiece model that puts a space before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        ids = np.arange(size).tolist()
        names = self.model.id_to_piece(ids)
        tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, names, strict=True)]
        if any(" " in p.replace("▁", " ").lstrip(" ") for p in names):
            raise ValueError("a piece spans words: texts cannot be encoded word by word")
        self.tokens = pa.array(tokens, pa.large_binary())
        self.memory = U.Memory(self._alone)

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each unit begins with a space, which the model puts there itself."""
        ids = self.model.encode([u[1:] for u in units], num_threads=1)
        # a lone space is a text of its own for the model only when it is asked for as two
        alone = [k for k, u in enumerate(units) if u == " "]
        for k in alone:
            ids[k] = [self.model.piece_to_id("▁")]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((k for x in ids for k in x), np.int32, int(sizes.sum())), sizes


@dataclass
class Side:
    """Tokens of several texts, one after the other: ids, lengths in bytes, and each text's first token."""

    ids: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray


@dataclass
class Aligned:
    """Links as token numbers of a and b, sorted; which links begin a group."""

    a: Side
    b: Side
    link_a: np.ndarray
    link_b: np.ndarray
    begins: np.ndarray


def owner_changes(a_sizes: np.ndarray, b_sizes: np.ndarray, owned: int = OWNED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive distinct pairs of owners of the same bytes, and where both change at once.

    The owner arrays are made for so many bytes at a time.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    total = int(a_ends[-1]) if len(a_ends) else 0
    last = (-1, -1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def owners(ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
        first, end = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        sizes = np.diff(np.minimum(ends[first:end], hi), prepend=lo)
        return np.repeat(np.arange(first, end, dtype=np.int32), sizes)

    for lo in range(0, total, owned):
        hi = min(lo + owned, total)
        own_a, own_b = owners(a_ends, lo, hi), owners(b_ends, lo, hi)
        new_a, new_b = np.diff(own_a, prepend=np.int32(last[0])) != 0, np.diff(own_b, prepend=np.int32(last[1])) != 0
        at = np.flatnonzero(new_a | new_b)
        out.append((own_a[at], own_b[at], (new_a & new_b)[at]))
        last = (int(own_a[-1]), int(own_b[-1]))
    if not out:
        none = np.empty(0, np.int32)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Aligner:
    """Two tokenizers and their common units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_sizes = pc.binary_length(self.a.tokens).to_numpy().astype(np.int64)
        self.b_sizes = pc.binary_length(self.b.tokens).to_numpy().astype(np.int64)
        # each id with what follows it in a text's groups: A , | and B , ; or nothing
        many_a, many_b = len(self.a.tokens), len(self.b.tokens)
        self.shown_at = np.array([0, many_a, 2 * many_a, 2 * many_a + many_b, 2 * many_a + 2 * many_b])
        self.shown = pa.array(
            [f"{k}{s}" for s in ",|" for k in range(many_a)] + [f"{k}{s}" for s in (",", ";", "") for k in range(many_b)], pa.large_string()
        )

    def align(self, texts: pa.Array) -> tuple[np.ndarray, Aligned]:
        """Which texts have tokens, and these texts' alignment; texts are without null and begin with a space."""
        good = np.ones(len(texts), bool)
        while True:
            some = texts if good.all() else U.plain(texts.filter(pa.array(good)))
            units, starts = U.cut(some, b" ")
            sides = []
            for side, sizes in ((self.a, self.a_sizes), (self.b, self.b_sizes)):
                ids, at = U.encoded(side.memory, units, starts)
                sides.append(Side(ids, sizes[ids], at))
            bad = self._different(some, sides)
            if not bad.any():
                break
            good[np.flatnonzero(good)[bad]] = False
        a, b = sides
        return good, Aligned(a, b, *owner_changes(a.sizes, b.sizes))

    def _different(self, texts: pa.Array, sides: list[Side]) -> np.ndarray:
        """Texts whose joined token bytes are not the text's."""
        data, offsets = U.bytes_of(texts)
        bad = np.zeros(len(texts), bool)
        for side, model in zip(sides, (self.a, self.b), strict=True):
            joined, at = U.bytes_of(model.tokens.take(pa.array(side.ids)))
            if len(joined) == len(data) and np.array_equal(joined, data):
                continue
            own = at[side.starts]
            for k in range(len(texts)):
                bad[k] |= not np.array_equal(joined[own[k] : own[k + 1]], data[offsets[k] : offsets[k + 1]])
        return bad

    def groups(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts' groups, and where each text's begin and end in them."""
        first_a, first_b = x.link_a[x.begins], x.link_b[x.begins]
        codes = np.empty(len(x.a.ids) + len(x.b.ids), np.int64)

        def numbered(first: np.ndarray, many: int) -> np.ndarray:
            out = np.zeros(many, np.int64)
            out[first] = 1
            return np.cumsum(out) - 1

        group_a, group_b = numbered(first_a, len(x.a.ids)), numbered(first_b, len(x.b.ids))
        last_a, last_b = np.append(first_a[1:], len(x.a.ids)) - 1, np.append(first_b[1:], len(x.b.ids)) - 1
        sep_a, sep_b = np.zeros(len(x.a.ids), np.int64), np.full(len(x.b.ids), 2)
        sep_a[last_a[last_a >= 0]] = 1
        sep_b[last_b[last_b >= 0]] = 3
        ends = x.b.starts[1:] - 1
        sep_b[ends[np.diff(x.b.starts) > 0]] = 4
        if len(first_a):
            codes[np.arange(len(x.a.ids)) + first_b[group_a]] = self.shown_at[sep_a] + x.a.ids
            codes[np.arange(len(x.b.ids)) + (last_a + 1)[group_b]] = self.shown_at[sep_b] + x.b.ids
        data, offsets = U.bytes_of(self.shown.take(pa.array(codes)))
        at = offsets[x.a.starts + x.b.starts]
        return data, at[:-1], at[1:]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts with a space before them, and which of them are empty or null."""
    texts = U.plain(texts)
    blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return U.plain(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))), blank


def align(documents: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens, links and groups of each whole text.

    Returns one row per input row: doc_id, a_ids, b_ids (array of int), links (array of struct of
    a and b, places in these from 0), groups (ids as `a1,a2|b1;a3|b2,b3`).

    * Null or empty texts, and texts whose tokens do not give the same bytes again, have no tokens.
    * Texts are aligned whole, whatever their length; owners are held for a few MB at a time.
    * Rows are treated alone: repeated rows give equal rows; a null doc_id stays null.  An empty
      table gives an empty result.  Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(a_path, b_path)
        for batch in W.steps(batches, size=STEP_BYTES):
            texts, blank = _spaced(batch.column("text"))
            held = np.flatnonzero(~blank)
            good, x = model.align(U.plain(texts.take(pa.array(held))))
            data, lo, hi = model.groups(x)
            links = np.searchsorted(x.link_a, x.a.starts)
            for k in range(len(blank)):
                place = np.searchsorted(held, k)
                if blank[k] or not good[place]:
                    row = ([], [], [], "")
                else:
                    d = int(good[:place].sum())
                    a0, b0 = int(x.a.starts[d]), int(x.b.starts[d])
                    own = slice(links[d], links[d + 1])
                    pairs = [{"a": p, "b": q} for p, q in zip((x.link_a[own] - a0).tolist(), (x.link_b[own] - b0).tolist(), strict=True)]
                    row = (x.a.ids[a0 : x.a.starts[d + 1]].tolist(), x.b.ids[b0 : x.b.starts[d + 1]].tolist(), pairs, data[lo[d] : hi[d]].tobytes().decode())
                arrays = [batch.column("_id").slice(k, 1), *[pa.array([v], t) for v, t in zip(row, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.string()), strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "a_ids", "b_ids", "links", "groups"])

    return docs.mapInArrow(run, f"_id {kind}, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, groups string").withColumnRenamed("_id", doc_id)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(blob: object, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), kind)


class _Shard:
    """Documents of a shard as they come, until they are one row."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = self.rows = 0

    def add(self, ids: pa.Array, texts: pa.Array, model: Aligner) -> None:
        spaced, blank = _spaced(texts)
        held = np.flatnonzero(~blank)
        good, x = model.align(U.plain(spaced.take(pa.array(held))))
        own = held[good]
        data, lo, hi = model.groups(x)
        view = memoryview(np.ascontiguousarray(data))
        digests = [""] * len(texts)
        for k, d in enumerate(own.tolist()):
            digests[d] = hashlib.sha256(view[lo[k] : hi[k]]).hexdigest()
        links = np.searchsorted(x.link_a, x.a.starts)
        groups = np.concatenate([[0], np.cumsum(x.begins)])[links]
        counts = np.zeros((4, len(texts)), np.int64)
        counts[:, own] = [np.diff(x.a.starts), np.diff(x.b.starts), np.diff(groups), np.diff(links)]
        # the distinct pairs of each document and how often it holds them
        pair = (x.a.ids[x.link_a].astype(np.int64) << HIGH) | x.b.ids[x.link_b]
        doc = np.repeat(np.arange(len(own)), np.diff(links))
        order = np.lexsort((pair, doc))
        pair, doc = pair[order], doc[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        sizes = np.zeros(len(texts), np.int64)
        sizes[own] = np.bincount(doc[at], minlength=len(own))
        self.ids.append(ids)
        self.counts.append(counts)
        self.digests += digests
        self.pairs.append(pair[at])
        self.times.append(np.diff(at, append=len(pair)).astype(np.int32))
        self.sizes.append(sizes)
        self.bytes += int(pc.sum(pc.binary_length(spaced)).as_py() or 0)
        self.rows += len(texts)

    def row(self) -> pa.RecordBatch:
        pairs, number, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        # numbers by falling frequency, so that most are small
        order = np.argsort(-docs, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ids = pa.concat_arrays(self.ids)
        blobs = [_packed(np.concatenate(self.counts, axis=1)), _packed(np.concatenate(self.sizes)), _packed(rank[number]), _packed(np.concatenate(self.times)), _packed(pairs[order]), _packed(docs[order])]
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([listed, *[pa.array([b], pa.binary()) for b in blobs], pa.array([self.digests])], ["ids", "counts", "sizes", "numbers", "times", "pairs", "docs", "digests"])


def shards(documents: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Documents in shards with their linked pairs of ids: the written form that link_counts and link_scores read."""
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard = aligner(a_path, b_path), _Shard()
        for batch in W.steps(batches, size=STEP_BYTES):
            shard.add(batch.column("_id"), batch.column("text"), model)
            if shard.bytes >= shard_bytes or shard.rows >= shard_rows:
                yield shard.row()
                shard = _Shard()
        if shard.rows:
            yield shard.row()
        W.release()

    blobs = ", ".join(f"{c} binary" for c in ("counts", "sizes", "numbers", "times", "pairs", "docs"))
    table = docs.mapInArrow(run, f"ids array<{kind}>, {blobs}, digests array<string>")
    return materialize(table.withColumn("shard", F.expr("uuid()")))


def _shard_pairs(table: DataFrame) -> DataFrame:
    """shard, number (of the pair in its shard), pair, docs (of the shard that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pairs, docs = _unpacked(batch.column("pairs")[k], "<i8"), _unpacked(batch.column("docs")[k], "<i8")
                for lo in range(0, len(pairs), 100_000):
                    some = slice(lo, lo + 100_000)
                    many = len(pairs[some])
                    arrays = [pa.repeat(batch.column("shard")[k], many), pa.array(np.arange(lo, lo + many, dtype=np.int32)), pa.array(pairs[some]), pa.array(docs[some])]
                    yield pa.RecordBatch.from_arrays(arrays, ["shard", "number", "pair", "docs"])

    return table.select("shard", "pairs", "docs").mapInArrow(run, "shard string, number int, pair long, docs long")


def link_counts(table: DataFrame) -> DataFrame:
    """How many documents hold each pair of ids linked: a, b, documents, best (the most of any pair of a)."""
    counts = _shard_pairs(table).groupBy("pair").agg(F.sum("docs").alias("documents"))
    counts = materialize(counts.select(F.shiftright("pair", HIGH).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << HIGH) - 1)).cast("int").alias("b"), "documents"))
    most = counts.groupBy("a").agg(F.max("documents").alias("best"))
    return counts.join(most, "a")


def link_scores(documents: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Counts of tokens, groups and links of each text, and of its links over the corpus.

    Returns one row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    held by as many documents as any pair of its A id), count_sum (over links, the documents that
    hold the pair), groups_sha256.

    * Null or empty texts, and texts whose tokens do not give the same bytes again: zeros and ''.
    * Rows are documents of their own, also those that repeat or have a null doc_id, and count so.
    * Texts count whole, whatever their length; a shard has about so many bytes, or one longer text.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    kind = documents.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()
    table = shards(documents, a_path, b_path, doc_id=doc_id, text=text, shard_bytes=shard_bytes, shard_rows=shard_rows)
    counts = materialize(link_counts(table).select(((F.col("a").cast("long") * F.lit(1 << HIGH)) + F.col("b")).alias("pair"), "documents", (F.col("documents") == F.col("best")).alias("is_best")))
    needed = _shard_pairs(table).drop("docs").join(counts, "pair").drop("pair")
    schema = f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        cell = {c: own.column(c)[0] for c in own.column_names}
        docs, best = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        place = found.column("number").to_numpy()
        docs[place], best[place] = found.column("documents").to_numpy(), found.column("is_best").to_numpy(zero_copy_only=False)
        sizes, numbers, times = _unpacked(cell["sizes"], "<i8"), _unpacked(cell["numbers"], "<i4"), _unpacked(cell["times"], "<i4").astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        counts = _unpacked(cell["counts"], "<i8").reshape(4, len(sizes))
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[numbers], times * docs[numbers])]
        columns = [own.column("ids").combine_chunks().flatten(), *[pa.array(c) for c in counts], *[pa.array(s[at[1:]] - s[at[:-1]]) for s in sums], own.column("digests").combine_chunks().flatten()]
        return pa.Table.from_arrays(columns, ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rest = table.drop("pairs", "docs")
    return rest.groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(run, schema).withColumnRenamed("_id", doc_id)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_scores(read(spark, sf_dir, "documents"), *default_files())
