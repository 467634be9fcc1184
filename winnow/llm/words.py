"""Words, word hashes and shingle hashes of whole texts, as numpy arrays over Arrow batches.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  Splitting works on the
UTF-8 bytes, so every other white space character (U+00A0, U+2003, ...) stays inside words.
A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one vectorised step holds at once; a longer single text forms its own step.
STEP_BYTES = 4 << 20

#: SQL for the words of documents.text, unchanged and with A-Z lower-cased.
_SPLIT = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
WORDS_SQL = _SPLIT.format("coalesce(text, '')")
FOLDED_WORDS_SQL = _SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_U = np.uint64
MULTIPLIERS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def release() -> None:
    """Give what Arrow and the C library hold free back to the system: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about size bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.float64))
        step = (np.cumsum(sizes) // size).astype(np.int64)
        cuts = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
    release()


@dataclass
class Words:
    """Words of several texts, one after the other: text i owns codes[starts[i]:starts[i + 1]]."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh3_64_intdigest
        words = self.vocabulary.cast(pa.binary()).to_pylist()
        return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text, coded against their own vocabulary; lower folds A-Z only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # a fresh copy: ascii_lower gives wrong offsets for slices
    texts = pa.concat_arrays([texts, texts[:0]])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(flat), 0)
    mask = real.to_numpy(zero_copy_only=False)
    if not mask.all():
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), offsets, coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(hashes: np.ndarray, n: int, multiplier: np.uint64 = MULTIPLIERS[0]) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * multiplier + hashes[k : k + size]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
