"""Repeated windows: the part that exact substring and suffix-array deduplication share.

A window is `width` consecutive symbols of one text (words or bytes). Each window picks the smallest hash among its
`gram`-symbol substrings, leftmost first, as its anchor. Equal windows pick equal anchors at equal places, so a window
can only repeat if its anchor does; about 2 in width - gram + 2 positions are anchors, each with a run of consecutive
windows. A run is (group g: the anchor's hash, class c: a hash of the symbols its windows span and of the anchor's place in them,
address). Runs that agree in both are copies as a whole; only classes of one group are compared with each other.

A group of too many classes is dealt anew by deeper anchors (see `halves`): windows that start u to v symbols before an
anchor all hold the symbols in between, so with each narrower range of u to v the common core grows, from the anchor's symbols to
the whole window, where all windows of a group are one class. So a passage in a third of all documents, with other
surroundings in each, makes no group that grows with them.

An address is a document and a long: 31 bits of the text's digest, which tell apart the texts of a repeated id, above
32 bits of a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged
from .textkernels import SPACE, blocks, mix, powers, span_hashes, word_hashes, words

PLACES = 24  # low bits of a key that hold a position; texts are cut into pieces below this length
PIECE = 1 << 22
WAYS = 4  # parts that the windows of a large group are dealt to in one step
CONTEXT = "g long, k long, times long, doc long, at long, p int, u int, v int, body binary"


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of symbol ranges, equal for equal ranges at any place."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def window_runs(symbols: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of all windows of the rows first[i]:first[i+1] of uint64 symbols: row, first window, end of the last
    window, anchor, anchor hash, context hash; places count from the row's first symbol."""
    n, span = len(symbols), width - gram + 1
    counts = np.diff(first)
    if not n or counts.max(initial=0) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = prefix_sums(symbols)
    at = np.arange(n - gram + 1)
    grams = range_hashes(sums, at, at + gram)
    key = ((grams >> np.uint64(PLACES)) << np.uint64(PLACES)) | at.astype(np.uint64)
    reach, least = 1, key
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: -(span - reach)], least[span - reach :])
    rows = np.flatnonzero(counts >= width)
    sizes = counts[rows] - width + 1
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(rows, sizes)
    start = np.repeat(first[rows] - begin, sizes) + np.arange(sizes.sum())
    anchor = (least[start] & np.uint64((1 << PLACES) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(start)) - 1
    lo, end, anchor, row = start[a], start[z] + width, anchor[a], row[a]
    context = mix(range_hashes(sums, lo, end) + (anchor - lo).astype(np.uint64))
    return row, lo - first[row], end - first[row], anchor - first[row], grams[anchor], context


def pieces(first: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Rows in pieces below PIECE symbols: (first row, offsets of its rows, symbols skipped in the first row). Long rows come
    alone, in pieces that overlap by width - 1, so each window is in one piece."""
    i, n = 0, len(first) - 1
    while i < n:
        size = first[i + 1] - first[i]
        if size > PIECE:
            for skip in range(0, max(1, size - width + 1), PIECE - width + 1):
                yield i, np.array([first[i] + skip, min(first[i] + skip + PIECE, first[i + 1])]), skip
            i += 1
            continue
        j = i + 1
        while j < n and first[j + 1] - first[i] <= PIECE:
            j += 1
        yield i, first[i : j + 1], 0
        i = j


def all_runs(symbols: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """window_runs over rows of any length."""
    parts = []
    for i, own, skip in pieces(first, width):
        row, lo, end, place, anchor, context = window_runs(symbols[own[0] : own[-1]].astype(np.uint64), own - own[0], width, gram)
        parts.append((row + i, lo + skip, end + skip, place + skip, anchor, context))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else window_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), width, gram)


def keyed(docs: DataFrame, doc: Column, *more: str) -> DataFrame:
    """(doc, row, text) and more columns of docs: row is the digest that addresses hold."""
    return docs.select(doc.alias("doc"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("row"), "text", *more)


def _whole(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def staged_runs(docs: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """(g, c, doc, at, n, p): the runs of docs (doc, row, text); n counts a run's windows, p symbols are before its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            symbols, first = word_hashes(data, offsets) if unit == "words" else (data, offsets)
            row, lo, stop, place, anchor, context = all_runs(symbols, first, width, gram)
            at = (_whole(batch.column("row"))[row] << 32) + lo
            counts = ((stop - lo - width + 1).astype(np.int32), (place - lo).astype(np.int32))
            yield pa.record_batch(
                [
                    pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), batch.column("doc").take(pa.array(row)),
                    pa.array(at), *map(pa.array, counts)
                ],
                names=["g", "c", "doc", "at", "n", "p"]
            )

    return staged(docs.mapInArrow(run, "g long, c long, doc long, at long, n int, p int"))


def split_side(table: DataFrame, other: str) -> DataFrame:
    """A table by g as a join's right side, dealt out by another column first: so the join has an exchange of its own on either
    side, and adaptive execution can split the rows of one g over several tasks."""
    return table.repartition("g", other)


def shared(runs: DataFrame, apart: str) -> DataFrame:
    """The runs of groups for which `apart` holds (of x and y, the smallest and largest doc, and the number of places), staged:
    what follows groups by g and c, and would else ask the join to keep each g in one task.

    Joins with runs keep all rows of their left side, and rows are chosen after them: the rows that a join makes do not
    depend on how much repeats."""
    seen = runs.groupBy("g").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count("*").alias("places")).filter(apart).select("g", "x", "y")
    return staged(runs.join(split_side(seen, "x"), "g", "left").filter("coalesce(x <= doc and doc <= y, false)").select("g", "c", "doc", "at"))


def by_place(spans: DataFrame, *fields: str) -> DataFrame:
    """One row for each (doc, row) with its distinct entries (lo and the fields); a text's entries are bounded by its length."""
    lo = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("lo")
    return spans.groupBy("doc", F.shiftright("at", 32).alias("row")).agg(F.collect_set(F.struct(lo, *fields)).alias("entries"))


def entries(batch: pa.RecordBatch, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The offsets of the rows' entries (null: none) and the fields as flat arrays."""
    column = batch.column("entries")
    sizes = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [np.asarray(flat.field(f)) for f in fields]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words at starts and ends, each with one space after it: the bytes, and the words' starts and ends in them."""
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    letters = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
    out[letters] = data[covered(len(data), starts, ends)] if len(data) else 0
    return out, begin, begin + sizes


def contexts(docs: DataFrame, rows: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """The symbols (body; words joined by one space) of the runs `rows` (g, k, times, doc, at, n, p), taken from docs; staged."""
    fields = ("lo", "n", "p", "g", "k", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            at, (lo, n, p, g, k, times) = entries(batch, *fields)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            if unit == "words":
                starts, ends, first = words(data, offsets)
                data, starts, ends = joined(data, starts, ends)
                x, y = lo + first[row], lo + first[row] + n + width - 1
                x, y = starts[x], ends[y - 1]
            else:
                x, y = lo + offsets[row], lo + offsets[row] + n + width - 1
            body = pa.array([data[i:j].tobytes() for i, j in zip(x, y, strict=True)], pa.binary())
            place = (_whole(batch.column("row"))[row] << 32) + lo
            fixed = (np.zeros(len(row), np.int32), np.full(len(row), width - gram, np.int32))
            columns = [
                pa.array(g), pa.array(k), pa.array(times), batch.column("doc").take(pa.array(row)), pa.array(place), pa.array(p),
                *map(pa.array, fixed), body
            ]
            yield pa.record_batch(columns, names=["g", "k", "times", "doc", "at", "p", "u", "v", "body"])

    return staged(docs.join(by_place(rows, *fields[1:]), ["doc", "row"]).mapInArrow(run, CONTEXT))


def halves(held: DataFrame, unit: str, width: int) -> DataFrame:
    """Contexts dealt to deeper groups, staged: the windows that start u to v symbols before the anchor are dealt to WAYS ranges of
    that distance, and each range's group is the hash of the symbols that all its windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "body"):
            starts, ends, first = words(data, offsets) if unit == "words" else (np.arange(len(data)), np.arange(1, len(data) + 1), offsets)
            sums = prefix_sums(span_hashes(data, starts, ends) if unit == "words" else data.astype(np.uint64))
            p, u, v, place = (_whole(batch.column(c)) for c in ("p", "u", "v", "at"))
            most = p - (np.diff(first) - width)
            step = -(-(v - u + 1) // WAYS)
            for way in range(WAYS):
                x, y = u + way * step, np.minimum(u + (way + 1) * step - 1, v)
                high, low = np.minimum(p, y), np.maximum(most, x)
                row = np.flatnonzero(low <= high)
                at, x, y, high, low = first[row] + p[row], x[row], y[row], high[row], low[row]
                core = range_hashes(sums, at - x, at - y + width)
                group = mix(core + mix((x << 32 | y).astype(np.uint64)))
                begin, end = at - high, at - low + width
                kind = mix(range_hashes(sums, begin, end) + high.astype(np.uint64))
                body = pa.array([data[i:j].tobytes() for i, j in zip(starts[begin], ends[end - 1], strict=True)], pa.binary())
                small = [pa.array(z.astype(np.int32)) for z in (high - low + 1, high, x, y)]
                own = [batch.column(c).take(pa.array(row)) for c in ("times", "doc")]
                columns = [pa.array(group.view(np.int64)), pa.array(kind.view(np.int64)), *own, pa.array(place[row] + p[row] - high), *small, body]
                yield pa.record_batch(columns, names=["g", "c", "times", "doc", "at", "n", "p", "u", "v", "body"])

    return staged(held.mapInArrow(run, "g long, c long, times long, doc long, at long, n int, p int, u int, v int, body binary"))


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0
