"""Stretches of text that tokenizers encode alone, and the ids that a worker remembers for them.

A unit begins with a blank after a character that is no white space.  Pre-tokenizers whose matches
are white space, or one optional blank and then no white space, have a border at each such place,
and what comes after it does not change what they match before; so a unit's ids do not depend on
its neighbours, and the many repeated units of a corpus are encoded once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: White space characters beyond ASCII as UTF-8, and control characters that not all engines call white space.
ODD = [chr(c).encode() for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ODD_LAST = np.zeros(256, bool)
_ODD_LAST[[c[-1] for c in ODD]] = True


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end, one range after the other."""
    sizes = ends - starts
    stops = np.cumsum(sizes, dtype=np.int64)
    out = np.repeat(starts - stops + sizes, sizes)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings without nulls whose buffers begin at its first text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pa.concat_arrays([texts, texts[:0]])


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array that plain gave, or of a result of take, and where each value starts (one more at the end)."""
    wide = np.int64 if array.type in (pa.large_string(), pa.large_binary()) else np.int32
    offsets = np.frombuffer(array.buffers()[1], wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def cut(texts: pa.Array, blanks: bytes = b" \t\n\v\f\r") -> tuple[pa.Array, np.ndarray]:
    """Units of the texts, one after the other, and the first unit of each text (one more entry at the end).

    A unit begins with one of blanks.
    """
    data, offsets = bytes_of(texts)
    space, begins = np.zeros(256, bool), np.zeros(256, bool)
    space[list(b" \t\n\v\f\r")] = True
    begins[list(blanks)] = True
    at = np.flatnonzero(begins[data[1:]] & ~space[data[:-1]]) + 1
    maybe = np.flatnonzero(_ODD_LAST[data[at - 1]])
    if len(maybe):
        odd = [any(data[max(p - 3, 0) : p].tobytes().endswith(c) for c in ODD) for p in at[maybe].tolist()]
        at = np.delete(at, maybe[odd])
    filled = offsets[:-1][np.diff(offsets) > 0]
    cuts = np.union1d(at, filled)
    units = binaries(data, np.append(cuts, len(data)))
    return units, np.searchsorted(cuts, offsets)


class Memory:
    """Values of units: encode gives those of some units, one after the other, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED) -> None:
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def of(self, codes: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Values of coded units, one after the other, and how many each has."""
        if len(self.known) > self.limit:
            self._forget()
        place = pc.index_in(vocabulary, self.known)
        fresh = vocabulary.filter(pc.is_null(place))
        if len(fresh):
            flat, sizes = self.encode(fresh.cast(pa.large_string()).to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            place = pc.index_in(vocabulary, self.known)
        at = place.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        first, last = self.ends[at], self.ends[at + 1]
        return self.flat[ranges(first, last)], last - first


def encoded(memory: Memory, units: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts from their units, and where each text's ids start (one more entry at the end)."""
    coded = units.dictionary_encode()
    flat, sizes = memory.of(coded.indices.to_numpy().astype(np.int64), coded.dictionary)
    return flat, np.concatenate([[0], np.cumsum(sizes)])[starts]
