"""CSV records of one file, or of a folder of part files, split and numbered in parallel over byte ranges.

Spark's line reader cuts a file into ranges of whole lines.  A range may begin inside a quoted field,
which its own lines do not tell.  So each range is read from both states that a line can begin in, at
a record's start and within quotes: what each gives is its records and the state it ends in.  With
one small row a range these functions are joined by prefix from the first range on, and then every
range knows its state and its first record's number.  A record that crosses ranges is put together
from its parts.  No task and no row holds a file; the driver sees one row a range.

A folder of part files, as Spark writes a table, is read as these files one after the other in the
order of their names: a range is known by its byte among all of them.  Each part begins with the
header, and no record goes on from one part to the next.
"""

from __future__ import annotations

import csv
import io
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A last line for the reader that is no data: where it comes back as part of a field, quotes are open.
_END = "\x1fend of range\x1f"
_BREAK = re.compile("(?<=\r)(?!\n)")
#: Records of one Arrow batch.
BATCH_RECORDS = 2000


@dataclass(frozen=True)
class Form:
    """How a file is written; columns are its header's, whose own words are in title."""

    encoding: str
    sep: str
    columns: tuple[str, ...]
    title: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Part:
    """A file, its name as Spark gives it with each line, and its first byte among all parts."""

    path: str
    name: str
    begin: int


def files(spark: SparkSession, path: str) -> list[Part]:
    """A file, or the non-empty files of a folder in the order of their names; one row a file reaches the driver."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", F.col("_metadata.file_name").alias("name")).collect()
    out, at = [], 0
    for r in sorted(rows, key=lambda r: r["path"]):
        if r["length"]:
            out.append(Part(r["path"], r["name"], at))
            at += r["length"]
    return out


def lines(spark: SparkSession, path: str, parts: list[Part] | None = None) -> DataFrame:
    """range (byte at which the reader's split begins) and line (bytes without the line's end), in order within a range.

    parts: the files of a folder.
    """
    own = spark.read.option("lineSep", "\n").text(path)
    start, line = F.col("_metadata.file_block_start"), F.col("value").cast("binary").alias("line")
    if parts is None or len(parts) < 2:
        return own.select(start.alias("range"), line)
    # one row a file; a join by broadcast keeps the lines' order
    table = spark.createDataFrame([(p.name, p.begin) for p in parts], "file string, begin long")
    own = own.select(F.col("_metadata.file_name").alias("file"), start.alias("start"), line)
    return own.join(F.broadcast(table), "file", "left").select((F.col("begin") + F.col("start")).alias("range"), "line")


def head(spark: SparkSession, path: str, many: int = 50) -> list[bytes]:
    """The first lines of a file, or of a folder's first part."""
    parts = files(spark, path)
    first = parts[0].path if len(parts) > 1 else path
    return [bytes(r["line"]) for r in lines(spark, first).filter("range = 0").limit(many).collect()]


class _Counted:
    """Iterator that knows how many lines were taken."""

    def __init__(self, source: Iterable[str]) -> None:
        self.source, self.taken = iter(source), 0

    def __iter__(self) -> _Counted:
        return self

    def __next__(self) -> str:
        line = next(self.source)
        self.taken += 1
        return line


def parsed(source: Iterable[str], sep: str) -> Iterator[list[str] | None]:
    """Fields of each record; None for one that the reader refuses."""
    csv.field_size_limit(2**31 - 1)
    source = iter(source)
    reader = csv.reader(source, delimiter=sep)
    while True:
        try:
            yield next(reader)
        except StopIteration:
            return
        except csv.Error:
            yield None
            reader = csv.reader(source, delimiter=sep)


def numbered(source: Iterable[str], sep: str) -> Iterator[tuple[int, int, list[str] | None]]:
    """First line, line after the last, and fields of each record."""
    counted, before = _Counted(source), 0
    for fields in parsed(counted, sep):
        yield before, counted.taken, fields
        before = counted.taken


def pieces(raw: Iterable[bytes], encoding: str, first: bool) -> Iterator[str]:
    """Decoded lines with their ends; a carriage return within one ends a line too."""
    for k, line in enumerate(raw):
        text = line.decode(encoding.removesuffix("-sig")) + "\n"
        if first and not k:
            text = text.removeprefix("\ufeff")
        if "\r" in text[:-2]:
            yield from _BREAK.split(text)
        else:
            yield text


def _good(fields: list[str] | None, columns: int) -> int:
    return int(fields is not None and 0 < len(fields) <= columns)


@dataclass
class Read:
    """A range read from one state: good and refused records, lines before its first record, its last record's first line if that is open."""

    good: int
    bad: int
    skip: int
    tail: int | None


def both(own: list[str], form: Form) -> tuple[Read, Read | None]:
    """A range read from a record's start and from within quotes; None if no record begins in the latter."""
    many = len(form.columns)
    starts, good, bad = [], [0], [0]
    tail = None
    for start, _, fields in numbered(chain(own, [_END]), form.sep):
        if fields == [_END]:
            break
        if fields and fields[-1].endswith(_END):
            tail = start
            break
        starts.append(start)
        ok = _good(fields, many)
        good.append(good[-1] + ok)
        bad.append(bad[-1] + (not ok and fields != []))
    outside = Read(good[-1], bad[-1], 0, tail)
    known = set(starts) | ({tail} if tail is not None else set())
    inner_good = inner_bad = 0
    skip = None
    for start, end, fields in numbered(chain(['"' + own[0]], own[1:], [_END]), form.sep):
        if fields == [_END]:
            return outside, Read(inner_good, inner_bad, len(own) if skip is None else skip, None)
        opened = bool(fields) and fields[-1].endswith(_END)
        if skip is None:
            if opened:
                return outside, None
            skip = end
            continue
        if start in known:  # from here on both read the same
            k = bisect_right(starts, start - 1)
            return outside, Read(inner_good + good[-1] - good[k], inner_bad + bad[-1] - bad[k], skip, tail)
        if opened:
            return outside, Read(inner_good, inner_bad, skip, start)
        ok = _good(fields, many)
        inner_good, inner_bad = inner_good + ok, inner_bad + (not ok and fields != [])
    return outside, Read(inner_good, inner_bad, len(own) if skip is None else skip, None)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    rows = ((r, x) for b in batches for r, x in zip(b.column("range").to_pylist(), b.column("line").to_pylist(), strict=True))
    for key, own in groupby(rows, key=lambda x: x[0]):
        yield key, (x for _, x in own)


_SUMMARY = "range long, inside boolean, closed boolean, good long, bad long, skip long, tail long"


def summaries(spark: SparkSession, path: str, form: Form, parts: list[Part] | None = None) -> DataFrame:
    """For each range and both states it may begin in: what it gives."""
    firsts = _firsts(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, raw in _by_range(batches):
            own = list(pieces(raw, form.encoding, key in firsts))
            outside, inside = both(own, form)
            rows = [(key, False, True, outside.good, outside.bad, 0, outside.tail)]
            rows.append((key, True, False, 0, 0, len(own), None) if inside is None else (key, True, True, inside.good, inside.bad, inside.skip, inside.tail))
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "inside", "closed", "good", "bad", "skip", "tail"])

    return lines(spark, path, parts).mapInArrow(run, _SUMMARY)


def _firsts(parts: list[Part] | None) -> frozenset[int]:
    """The ranges with which files begin."""
    return frozenset(p.begin for p in parts or []) | {0}


@dataclass
class Place:
    """How a range is to be read: its lines before the first record and whose they are, its open last record, its first number."""

    skip: int
    owner: int | None
    tail: int | None
    good: int
    number: int = 0


def places(rows: list, firsts: frozenset[int] = frozenset({0})) -> tuple[dict[int, Place], int]:
    """Each range's place by prefix over all ranges, and how many records were refused; files begin with the ranges in firsts."""
    told: dict[int, dict[bool, object]] = {}
    for r in rows:
        told.setdefault(r["range"], {})[r["inside"]] = r
    out, owner, refused = {}, None, 0
    for key in sorted(told):
        if key in firsts:  # a quote that is open at a file's end closes there
            owner = None
        r = told[key][owner is not None]
        # the first record of a file is its header
        if key in firsts and r["good"] < 1:
            raise ValueError("the header does not end in the first range")
        out[key] = Place(r["skip"], owner, r["tail"], r["good"] - (key in firsts))
        refused += r["bad"]
        if r["closed"]:
            owner = key if r["tail"] is not None else None
    return out, refused


def _table(records: list[tuple[int, list[str]]], columns: int) -> pa.RecordBatch:
    padded = [[x or None for x in f] + [None] * (columns - len(f)) for _, f in records]
    cells = list(zip(*padded, strict=True)) if padded else [[]] * columns
    arrays = [pa.array(c, pa.string()) for c in cells]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([n for n, _ in records], pa.int64())], [*[f"c{k}" for k in range(columns)], "satir_no"])


def read_records(spark: SparkSession, path: str, form: Form) -> tuple[DataFrame, int]:
    """All columns as strings (an empty field is null) with satir_no, and the number of refused records.

    satir_no counts records that fit from 2 on, in the file's order, whatever its ranges.  Blank
    lines do not count; a record with more fields than the header is refused, one with fewer has
    nulls.  An open quote at the file's end closes there.
    """
    many = len(form.columns)
    own_files = files(spark, path)
    firsts = _firsts(own_files)
    where, refused = places(summaries(spark, path, form, own_files).collect(), firsts)
    shared = spark.sparkContext.broadcast(where)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, raw in _by_range(batches):
            place = shared.value[key]
            if place.owner is None and place.tail is None:
                continue
            own = list(pieces(raw, form.encoding, key in firsts))
            found = [(place.owner, key, "".join(own[: place.skip]))] if place.owner is not None else []
            if place.tail is not None:
                found.append((key, key, "".join(own[place.tail :])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["owner", "range", "part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, text in zip(batch.column("owner").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fields = next(parsed(io.StringIO(text, newline=""), form.sep), None)
                ok = _good(fields, many)
                table = _table([(owner, fields if ok else [])], many)
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array([bool(ok)])], [*table.schema.names, "fits"])

    schema = ", ".join([*[f"c{k} string" for k in range(many)], "satir_no long"])
    crossing = None
    if any(p.tail is not None for p in where.values()):
        whole = lines(spark, path, own_files).mapInArrow(parts, "owner long, range long, part string").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("range", "part"))).alias("p"))
        text = whole.select("owner", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))
        crossing = text.mapInArrow(joined, f"{schema}, fits boolean").checkpoint()
    fits = {r["satir_no"]: r["fits"] for r in crossing.select("satir_no", "fits").collect()} if crossing is not None else {}
    refused += sum(not ok for ok in fits.values())
    number = 2
    last: dict[int, int] = {}
    for key in sorted(where):
        where[key].number = number
        number += where[key].good
        last[key] = number
        number += bool(fits.get(key))
    placed = spark.sparkContext.broadcast(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, raw in _by_range(batches):
            place = placed.value[key]
            source = pieces(raw, form.encoding, key in firsts)
            records, n, title = [], place.number, key in firsts
            end = None if place.tail is None else place.tail - place.skip
            for start, _, fields in numbered(islice(source, place.skip, None), form.sep):
                if end is not None and start >= end:
                    break
                if not _good(fields, many):
                    continue
                if title:
                    if form.title is not None and tuple(fields) != form.title:
                        raise ValueError(f"{path}: the parts' headers differ")
                    title = False
                    continue
                records.append((n, fields))
                n += 1
                if len(records) == BATCH_RECORDS:
                    yield _table(records, many)
                    records = []
            if records:
                yield _table(records, many)

    out = lines(spark, path, own_files).mapInArrow(run, schema)
    if crossing is not None:
        numbers = spark.createDataFrame([(k, last[k]) for k, ok in fits.items() if ok] or [(-1, 0)], "satir_no long, number long")
        out = out.union(crossing.filter("fits").join(numbers, "satir_no").select(*[f"c{k}" for k in range(many)], "number"))
    return out.toDF(*form.columns, "satir_no"), refused
