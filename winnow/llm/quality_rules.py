"""Quality rules: base counts of a text, and compression bands.

A band has limits for the zstandard ratio (bytes of text for each compressed byte) that suit
texts of its length: prose of some length compresses within a narrow range, repetition lies far
above it and random characters lie below.  The whole text is judged by the limits of its length;
chunks of it, the last partial one too, are judged one by one by the limits of theirs, so that a
long text with a repetitive or random part cannot hide it in the average.

Lower limits lie between random base64 characters and the least prose of the given documents; from
1024 bytes they also lie above random words of six and more letters.  In shorter texts random
letters in words compress as well as prose does, so no limit can part the two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import carried, read, uncarried


@dataclass(frozen=True)
class Bands:
    """below: upper end of each length band in bytes (the last is open); low, high: its limits."""

    below: tuple[int, ...] = (64, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 4096, 8192, 16384)
    low: tuple[float, ...] = (0.0, 0.95, 1.0, 1.1, 1.24, 1.32, 1.38, 1.52, 1.66, 1.74, 1.78, 1.8, 1.82, 1.9)
    high: tuple[float, ...] = (3.0, 3.0, 3.0, 3.0, 2.9, 2.9, 2.9, 2.9, 3.3, 3.3, 3.3, 3.6, 3.6, 4.0)
    chunk_bytes: int = 4096
    chunk_low: float = 1.8
    chunk_high: float = 3.6
    max_bad_share: float = 0.25
    level: int = 3

    def verdict(self, data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
        """Ratio of the whole text, share of its bytes in bad chunks, and whether it is kept."""
        if not data:
            return 0.0, 0.0, False
        ratio = len(data) / len(compressor.compress(data))
        low, high = self.limits(len(data))
        bad = 0
        size = self.chunk_bytes
        for at in range(0, len(data) if len(data) > size else 0, size):
            part = data[at : at + size]
            least, most = (self.chunk_low, self.chunk_high) if len(part) == size else self.limits(len(part))
            bad += len(part) * (not least <= len(part) / len(compressor.compress(part)) <= most)
        share = bad / len(data)
        return ratio, share, low <= ratio <= high and share <= self.max_bad_share

    def limits(self, size: int) -> tuple[float, float]:
        band = int(np.searchsorted(self.below, size, side="right"))
        return self.low[band], self.high[band]


SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_WORD_START = np.array([b & 0xC0 != 0x80 and b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def _per_text(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])


def repeated_words(words: W.Words) -> np.ndarray:
    """For each text, the words inside 3-word windows that occur twice or more in it."""
    c, n = words.codes, len(words.codes)
    out = np.zeros(len(words.starts) - 1, np.int64)
    if n < 3:
        return out
    size = len(words.vocabulary)
    pairs = pd.factorize(c[:-1] * size + c[1:])[0]
    triples = pd.factorize(pairs[:-1] * size + c[2:])[0]
    text = np.repeat(np.arange(len(out)), words.counts)
    inside = text[:-2] == text[2:]
    keys = pd.factorize(text[:-2] * (int(triples.max()) + 1) + triples)[0]
    many = inside & (np.bincount(keys[inside], minlength=int(keys.max()) + 1)[keys] >= 2)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= many
    return np.bincount(text[covered], minlength=len(out)).astype(np.int64)


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunk_share double, kept boolean"


def quality_rules(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bands: Bands = Bands(), carry: tuple[str, ...] = ()
) -> DataFrame:
    """Base counts and the verdict of the compression bands for each document, in one pass.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, ratio, bad_chunk_share, kept, then the carried columns.

    * A null text has no words; a null or empty text has ratio 0, fails the base and is not kept.
    * Each row is judged alone: repeated rows get equal verdicts, and a null doc_id stays null.
    * Texts are compressed whole, of any length.  An empty table gives an empty result.
    * Other columns are ignored unless carried, whatever their names.
    """
    docs = documents.select(
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text"), carried(carry).alias("_carry")
    )
    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, _carry {docs.schema['_carry'].dataType.simpleString()}, {FEATURES}"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in W.steps(batches):
            texts = pc.fill_null(batch.column("text"), "")
            words = W.split(texts)
            raw = pc.cast(texts, pa.large_string())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            n_words, n_repeat = words.counts, repeated_words(words)
            strings = texts.to_pylist()
            verdicts = [bands.verdict(t.encode(), compressor) for t in strings]
            failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
            columns = {
                "_id": batch.column("_id"),
                "_carry": batch.column("_carry"),
                "n_words": pa.array(n_words, pa.int64()),
                "word_chars": pa.array(_per_text(_IS_WORD_START[data], ends), pa.int64()),
                "n_symbols": pa.array(_per_text(_IS_SYMBOL[data], ends), pa.int64()),
                "n_dup_lines": pa.array([dup_lines(t) for t in strings], pa.int64()),
                "n_repeat_words": pa.array(n_repeat, pa.int64()),
                "base_failed": pa.array(failed),
                "ratio": pa.array([v[0] for v in verdicts], pa.float64()),
                "bad_chunk_share": pa.array([v[1] for v in verdicts], pa.float64()),
                "kept": pa.array(~failed & np.array([v[2] for v in verdicts], bool)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = docs.mapInArrow(judge, schema)
    return out.select(F.col("_id").alias(doc_id), *[x.split()[0] for x in FEATURES.split(", ")], *uncarried(carry))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
