"""Packing: tokenised documents in fixed windows by the sum-of-squares rule.

A document's ids are cut into full windows and a remainder.  Remainders are packed shard by
shard, online: with N(h) the number of windows filled up to level h, each remainder goes where
the sum of N(h)^2 afterwards is least, which keeps all levels available and wastes little.  Of the
windows still open when a shard ends the fullest stay and are filled up with cuts of the documents
in the emptiest; what is left of these, less than one window, is cut at powers of two, which need
no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import materialize, read

#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: The steps of the word tokenizer for which a word of these small letters, or a run of
#: ASCII marks without the apostrophe, is one unit that no step changes.
WORD_STEPS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = r"[!-&(-/:-@\[-`{-~]"
LETTER = "[a-zß-öø-ÿ]"
UNIT = f"^(?:{LETTER}+|{MARK}+)$"
#: All special tokens of that tokenizer hold this; what holds it goes the plain way.
SPECIAL = "<|"


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins characters across ASCII blanks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.units: Tokenizer | None = None
        layout = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (layout["normalizer"] or {}).get("normalizers", [])]
        first, *others = (layout["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = first.get("pattern", {}).get("Regex")
        special = all(SPECIAL in x["content"] for x in layout["added_tokens"])
        suffix = layout["model"].get("end_of_word_suffix")
        if steps == WORD_STEPS and pattern == WORD_PATTERN and [x["type"] for x in others] == ["ByteLevel"] and special and suffix:
            self.units = Tokenizer(self.tokenizer.model)
            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
            vocabulary = layout["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.empty(0, np.uint32)
        self.lengths = np.empty(0, np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units at once, and how many each has: its last id, and no other, ends a word."""
        lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.units.encode_batch_fast(lines, add_special_tokens=False)])
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def _learn(self, words: pa.Array) -> None:
        if self.units is not None:
            unit = pc.and_(pc.match_substring_regex(words, UNIT), pc.invert(pc.match_substring(words, SPECIAL)))
            parts = [(words.filter(unit), self._units), (words.filter(pc.invert(unit)), self._alone)]
        else:
            parts = [(words, self._alone)]
        for part, encode in parts:
            for k in range(0, len(part), 50_000):
                some = part.slice(k, 50_000)
                flat, lengths = encode(some.to_pylist())
                assert len(lengths) == len(some)
                self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
                self.known = pa.concat_arrays([self.known, some])

    def _eased(self, texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer distinct words: small letters, a blank before marks."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # a fresh copy: ascii_lower gives wrong offsets for slices
        texts = pa.concat_arrays([texts, texts[:0]])
        eased = pc.replace_substring_regex(pc.ascii_lower(texts), f"({LETTER})({MARK})", r"\1 \2")
        return pc.if_else(pc.match_substring(texts, SPECIAL), texts, eased)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start (one more entry at the end)."""
        words = W.split(texts if self.units is None else self._eased(texts))
        vocabulary = words.vocabulary.cast(pa.large_string())
        if len(self.known) > REMEMBERED:
            self._forget()
        place = pc.index_in(vocabulary, self.known)
        fresh = vocabulary.filter(pc.is_null(place))
        at = place.fill_null(-1).to_numpy().astype(np.int64)
        if len(fresh):
            before = len(self.known)
            self._learn(fresh)
            at[at < 0] = before + pc.index_in(fresh, self.known[before:]).to_numpy()
        own = at[words.codes]
        offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        ids = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(self.flat)).take(pa.array(own)).flatten()
        ends = np.concatenate([[0], np.cumsum(self.lengths[own])])
        return ids.to_numpy(), ends[words.starts]


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


class SumOfSquares:
    """Windows of one size; counts[h] is the number of windows filled up to level h."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.windows: list[list[int]] = []

    def place(self, item: int, length: int) -> None:
        n, last = self.counts, self.size - length
        # half the change of the sum of squares, less a constant, for the levels 0 to last
        change = 2 * (n[length:] - n[: last + 1]) + 2
        change[n[: last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[length] + 1 if length < self.size else 0
        if n[last] and last:
            change[last] = 1 - 2 * n[last]
        level = last - int(np.argmin(change[::-1]))  # of equal levels the fullest
        if level:
            window = self.at[level].pop()
            n[level] -= 1
            self.windows[window].append(item)
        else:
            window = len(self.windows)
            self.windows.append([item])
        if level + length < self.size:
            n[level + length] += 1
            self.at[level + length].append(window)

    def partial(self) -> list[int]:
        """Windows that are not full, the fullest first."""
        return [w for level in reversed(self.at) for w in level]


def powers_of_two(length: int) -> list[int]:
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


def pack_shard(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length) that hold every item whole or cut."""
    state = SumOfSquares(size)
    for item, length in enumerate(lengths):
        state.place(item, length)
    opened = state.partial()
    rest = set(opened)
    out = [[(i, 0, lengths[i]) for i in w] for k, w in enumerate(state.windows) if k not in rest]
    total = sum(lengths[i] for w in opened for i in state.windows[w])
    stay, go = opened[: total // size], opened[total // size :]
    pieces = [(i, 0, lengths[i]) for w in reversed(go) for i in state.windows[w]]

    def taken(many: int) -> list[tuple[int, int, int]]:
        got = []
        while many:
            item, start, length = pieces.pop()
            step = min(many, length)
            got.append((item, start, step))
            if step < length:
                pieces.append((item, start + step, length - step))
            many -= step
        return got

    for w in stay:
        own = [(i, 0, lengths[i]) for i in state.windows[w]]
        out.append(own + taken(size - sum(n for _, _, n in own)))
    return out + [taken(n) for n in powers_of_two(total % size)]


class _Blobs:
    """Ids of single rows of a binary column, without a copy of the column."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        self.chunks = column.chunks
        self.first = np.cumsum([0, *map(len, self.chunks)])

    def ids(self, row: int, length: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, row, side="right")) - 1
        data = self.chunks[k][row - int(self.first[k])].as_buffer()
        return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4")


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    end_id: int = 1,
    shard_rows: int = 40_000,
    shard_pieces: int = 400_000,
) -> DataFrame:
    """Pack all documents into sequences of at most window ids; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A shard has about
    shard_rows remainders (of less than window ids each) and at most about shard_pieces full
    windows, which travel without their ids, so no task holds more than that.  Every shard's
    sequences are full or a power of two long, so nothing is padded.

    * A null text is the empty text: one piece with the end id alone.
    * Repeated rows are packed once each; a null doc_id is kept as null.
    * Equal rows are interchangeable; all else is ordered by doc_id, text hash and start, so reruns agree.
    * A very long text gives many full pieces.  An empty table gives an empty result.
    * Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-total[0] // shard_rows), -(-total[1] // (window * shard_pieces)))
    docs = docs.select("_id", "text", F.xxhash64("_id", "text").alias("_hash"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in W.steps(batches):
            ids, starts = tokenizer.encode(batch.column("text"))
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)).astype("<u4")
                total = len(own)
                for start in range(0, total - total % window, window):
                    rows.append((k, start, window, zlib.crc32(own[start : start + window].tobytes()), total, None))
                if rest := total % window:
                    tail = own[total - rest :]
                    narrow = tail.astype("<u2") if tail.max() < 1 << 16 else tail
                    rows.append((k, total - rest, rest, 0, total, narrow.tobytes()))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column("_id").take(at), batch.column("_hash").take(at)]
            columns += [pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3, 4)]
            columns.append(pa.array([r[5] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_hash", "start", "length", "crc", "total", "ids"])

    pieces = materialize(docs.mapInArrow(cut, f"_id {id_type}, _hash long, start long, length long, crc long, total long, ids binary"))
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64("_hash", "start"), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        _LOADED.clear()  # texts are cut by now: the words that the worker remembers make room
        W.release()
        order = pc.sort_indices(table.select(["_id", "_hash", "start"]), sort_keys=[("_id", "ascending"), ("_hash", "ascending"), ("start", "ascending")]).to_numpy()
        shard = table.column("_shard")[0].as_py()
        start, length, crc, total = (table.column(c).to_numpy() for c in ("start", "length", "crc", "total"))
        whole = (start[order] + window <= total[order]) & (length[order] == window)
        full, rest = order[whole], order[~whole]
        blobs = _Blobs(table.column("ids"))
        sequences = pack_shard(length[rest].tolist(), window)
        many = len(full) + sum(map(len, sequences))
        columns = np.zeros((6, many), np.int64)  # row, offset in it, length, checksum, sequence, place
        columns[0, : len(full)], columns[2, : len(full)], columns[3, : len(full)] = full, window, crc[full]
        columns[4, : len(full)] = np.arange(len(full))
        k = len(full)
        for number, sequence in enumerate(sequences, len(full)):
            place = 0
            for i, s, n in sequence:
                row = int(rest[i])
                columns[:, k] = row, s, n, zlib.crc32(blobs.ids(row, int(length[row]))[s : s + n].astype("<u4").tobytes()), number, place
                place += n
                k += 1
        own, at = columns[0], pa.array(columns[0])
        values = [start[own] + columns[1], columns[2], columns[3], total[own], shard << 32 | columns[4], columns[5]]
        out = pa.Table.from_arrays([table.column("_id").take(at), *map(pa.array, values)], ["_id", *[x.split()[0] for x in PIECES.split(", ")]])
        del blobs, table
        W.release()
        return out

    out = pieces.groupBy("_shard").applyInArrow(packed, f"_id {id_type}, {PIECES}")
    return out.withColumnRenamed("_id", doc_id)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
