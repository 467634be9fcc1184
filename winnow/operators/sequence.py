"""Whether the sequence ratio of two texts reaches a threshold, with exact bounds.

The ratio is 2 M / T, where T is both lengths together and M the characters in matching blocks: the
longest common block (earliest in a, then in b), then the same to its left and right.  M is at most
the characters that the texts have in common as multisets, a bound that column expressions give; and
while blocks are found, what the ranges left can still add bounds it further.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_bound(u: Column, v: Column) -> Column:
    """The ratio is at most this: all characters of the shorter text match."""
    return 2.0 * F.least(F.length(u), F.length(v)) / (F.length(u) + F.length(v))


def character_bound(u: Column, v: Column) -> Column:
    """The ratio is at most this: as many of each character match as the text with fewer of it has."""

    def held(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    letters = F.array_distinct(F.regexp_extract_all(u, F.lit(r"([\s\S])"), 1))
    shared = F.aggregate(letters, F.lit(0), lambda s, c: s + F.least(held(u, c), held(v, c)))
    return 2.0 * shared / (F.length(u) + F.length(v))


class Automaton:
    """Suffix automaton of a text: for each of its substrings where it first ends."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for k, c in enumerate(text):
            new = self._state({}, self.length[last] + 1, k)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1, self.first[q])
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, following: dict[str, int], length: int, first: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """Place in text, place in the automaton's text, and size of the longest common block; the earliest of equal ones."""
        state = size = 0
        best = (0, 0, 0)
        for k, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
                if size > best[2]:
                    best = (k - size + 1, self.first[state] - size + 1, size)
        return best


def reaches(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio of a and b is at least threshold; two empty texts have the ratio 1."""
    total = len(a) + len(b)
    if not total:
        return threshold <= 1
    left = [(0, len(a), 0, len(b))]
    matched, can = 0, min(len(a), len(b))
    while left and 2.0 * matched / total < threshold <= 2.0 * (matched + can) / total:
        left.sort(key=lambda r: min(r[1] - r[0], r[3] - r[2]))
        a0, a1, b0, b1 = left.pop()
        can -= min(a1 - a0, b1 - b0)
        i, j, size = Automaton(b[b0:b1]).longest(a[a0:a1])
        if not size:
            continue
        matched += size
        for part in ((a0, a0 + i, b0, b0 + j), (a0 + i + size, a1, b0 + j + size, b1)):
            most = min(part[1] - part[0], part[3] - part[2])
            if most:
                left.append(part)
                can += most
    return 2.0 * matched / total >= threshold


def close_pairs(pairs: DataFrame, threshold: float, first: str = "v", second: str = "u") -> DataFrame:
    """Pairs of texts whose ratio, first before second, reaches the threshold; bounds in columns leave few to be read."""
    a, b = F.col(first), F.col(second)
    possible = pairs.filter(length_bound(a, b) >= threshold).filter(character_bound(a, b) >= threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(first).to_pylist(), batch.column(second).to_pylist(), strict=True)
            yield batch.filter(pa.array([reaches(x, y, threshold) for x, y in texts], pa.bool_()))

    return possible.mapInArrow(run, pairs.schema)


def funnel(pairs: DataFrame, threshold: float, first: str = "v", second: str = "u") -> DataFrame:
    """How many pairs there are, pass each bound, and reach the ratio."""
    a, b = F.col(first), F.col(second)
    by_length = length_bound(a, b) >= threshold
    bounded = pairs.agg(F.count("*").alias("pairs"), F.count_if(by_length).alias("by_length"), F.count_if(by_length & (character_bound(a, b) >= threshold)).alias("by_characters"))
    return bounded.join(close_pairs(pairs, threshold, first, second).agg(F.count("*").alias("close")))  # one row each
