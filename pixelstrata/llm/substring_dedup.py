"""Substring deduplication by suffix automata of reference shards and matching statistics.

A word goes if a window of `width` words that covers it also starts in a document of a smaller doc_id. Reference shards
are automata over texts of smaller documents; a later text is streamed through them, and where its matching statistic (the
longest suffix that the shard holds) reaches the width, the maximal span goes.

Sending every shard to every document would cost documents times shards, so shards are dealt by content: only windows
with an equal anchor can be equal (see repeats), so a shard holds the contexts of one anchor, and only contexts of that
anchor are streamed through it. Equal contexts are one sequence of their shard, streamed once for their smallest document; as the
shard then holds the whole sequence, its later documents lose it whole. All else is decided by matching statistics. An anchor
of over SHARD different contexts is dealt to deeper anchors, shard by shard, until each automaton is within that bound;
contexts are compared word by word there, not by hash.

Defined cases: null or wordless texts have 0 words; rows with a null doc_id keep everything and are no reference; repeated
rows of a doc_id, of equal or other texts, return a row each and are no reference for each other; windows are judged
on the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import by_place, contexts, covered, entries, halves, keyed, shared, split_side, staged_runs
from .tables import drop_staged, staged
from .textkernels import SPACE, blocks, words

GRAM = 8
SHARD = 250  # contexts, each of at most 2 * width words


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.symbols = 0

    def add(self, sequence: list[int]) -> None:
        last = 0
        for x in sequence:
            last = self._extend(last, x)
        self.symbols += len(sequence)

    def _extend(self, last: int, x: int) -> int:
        go, link, length = self.next, self.link, self.length
        there = go[last].get(x)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._clone(last, x, there)
        new = self._state({}, -1, length[last] + 1)
        at = last
        while at >= 0 and x not in go[at]:
            go[at][x] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            there = go[at][x]
            link[new] = there if length[there] == length[at] + 1 else self._clone(at, x, there)
        return new

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, at: int, x: int, there: int) -> int:
        go, link = self.next, self.link
        new = self._state(dict(go[there]), link[there], self.length[at] + 1)
        link[there] = new
        while at >= 0 and go[at].get(x) == there:
            go[at][x] = new
            at = link[at]
        return new

    def matching(self, sequence: list[int]) -> Iterator[int]:
        """For each place, the length of the longest substring ending there that the automaton holds."""
        at = size = 0
        go, link, length = self.next, self.link, self.length
        for x in sequence:
            while at and x not in go[at]:
                at = link[at]
                size = length[at]
            if x in go[at]:
                at = go[at][x]
                size += 1
            else:
                size = 0
            yield size


def long_spans(automaton: SuffixAutomaton, sequence: list, width: int) -> list[tuple[int, int]]:
    """Maximal ranges of the sequence covered by matches of at least `width`."""
    out: list[tuple[int, int]] = []
    for end, size in enumerate(automaton.matching(sequence)):
        if size >= width:
            if out and end - size < out[-1][1]:
                out[-1] = (out[-1][0], end + 1)
            else:
                out.append((end + 1 - size, end + 1))
    return out


def _stream(width: int):
    """Rows (g, doc, at, body), by g and then doc: streams each document through the automaton of the smaller ones. Gives
    (doc, at, size) of the spans found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, document, shard, waiting = None, None, None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for g, doc, at, body in zip(*(batch.column(c).to_pylist() for c in ("g", "doc", "at", "body")), strict=True):
                if g != group:
                    group, document, shard, waiting = g, doc, None, []
                if doc != document:
                    document = doc
                    shard = shard or SuffixAutomaton()
                    for sequence in waiting:
                        shard.add(sequence)
                    waiting = []
                sequence = body.split(b" ")
                if shard:
                    out += [(doc, at + x, y - x) for x, y in long_spans(shard, sequence, width)]
                if sequence not in waiting:
                    waiting.append(sequence)
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["doc", "at", "size"])

    return run


def _judged(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Rows (g, c, doc, ...) of a class that has a smaller document (m, its smallest), and the first rows of classes of groups
    (k: the group's classes) that differ and have several documents; staged. several: all rows of such groups, at least."""
    classes = several.groupBy("g", "c").agg(F.min("doc").alias("m"))
    groups = classes.groupBy("g").agg(F.count("*").alias("k"), F.min("m").alias("x"), F.max("m").alias("y"))
    groups = groups.filter("k > 1 and x < y").select("g", "k")
    known = rows.join(classes.join(split_side(groups, "k"), "g", "left"), ["g", "c"], "left")
    return staged(known.filter("coalesce(doc > m, false) or coalesce(doc = m and k > 1, false)"))


def repeated_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc, at, size): word ranges of docs (doc, row, text) that go, staged; their union is what goes."""
    later = F.expr(f"cast(n + {width} - 1 as bigint)").alias("size")
    runs = staged_runs(docs, "words", width, GRAM)
    several = shared(runs, "x < y")
    judged = _judged(runs, several)
    drop_staged(runs, several)
    found = [judged.filter("doc > m").select("doc", "at", later)]
    held = contexts(docs, judged.filter("doc = m").withColumn("times", F.lit(1).cast("long")), "words", width, GRAM)
    made = [judged, held]
    while True:
        small = held.filter(F.col("k") <= SHARD).select("g", "doc", "at", "body").repartition("g").sortWithinPartitions("g", "doc", "at")
        found.append(small.mapInArrow(_stream(width), "doc long, at long, size long"))
        large = held.filter(F.col("k") > SHARD)
        if large.isEmpty():
            break
        parts = halves(large, "words", width)
        judged = _judged(parts, parts)
        drop_staged(parts)
        found.append(judged.filter("doc > m").select("doc", "at", later))
        held = judged.filter("doc = m")
        made.append(judged)
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    spans = staged(spans)
    drop_staged(*made)
    return spans


def _clean(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            starts, ends, first = words(data, offsets)
            at, (lo, size) = entries(batch, "lo", "size")
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            gone = covered(len(starts), lo + first[row], lo + size + first[row])
            kept = np.flatnonzero(~gone)
            owner = np.searchsorted(first, kept, "right") - 1
            last = np.ones(len(kept), bool)
            last[:-1] = owner[1:] != owner[:-1]
            plain = np.where(SPACE[data], np.uint8(0x20), data) if len(data) else data
            mask = covered(len(data) + 1, starts[kept], ends[kept] + ~last)[: len(data)]
            cuts = np.concatenate([[0], np.cumsum(mask)])[offsets]
            left = plain[mask].tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            out = [left[cuts[i] : cuts[i + 1]] for i in range(batch.num_rows)]
            last_column = pa.array(out, pa.binary()).cast(pa.string()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
            yield pa.record_batch(
                [batch.column("doc"), pa.array(np.diff(first)), pa.array(np.diff(removed)), last_column],
                names=["doc", "n_words", "n_removed", "kept"]
            )

    return run


def substring_dedup(docs: DataFrame, width: int = 50, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs: kept words joined by one space, or (texts=False) their sha256."""
    own = keyed(docs, F.col("doc_id").cast("long"))
    spans = by_place(repeated_spans(own.filter("doc is not null"), width), "size")
    out = own.join(spans, ["doc", "row"], "left").mapInArrow(_clean(texts), "doc long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc", "doc_id")


#: A text's entries beside the columns of its row.
HELD = "pixelstrata_entries"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of docs with their entries: the same rows, text and n_chars as they are after the removal."""
    for batch, data, offsets in blocks(batches):
        starts, ends, first = words(data, offsets)
        at, (lo, size) = entries(pa.record_batch([batch.column(HELD)], names=["entries"]), "lo", "size")
        texts = batch.column("text").to_pylist()
        changed = np.flatnonzero(np.diff(at))
        for i in changed:
            own, held = slice(first[i], first[i + 1]), slice(at[i], at[i + 1])
            gone = covered(first[i + 1] - first[i], lo[held], lo[held] + size[held])
            texts[i] = b" ".join(data[a:b].tobytes() for a, b, g in zip(starts[own], ends[own], gone, strict=True) if not g).decode()
        columns = {n: batch.column(n) for n in batch.schema.names if n != HELD}
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            counts = columns["n_chars"].to_pylist()
            for i in changed:
                counts[i] = len(texts[i])
            columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
        yield pa.record_batch(list(columns.values()), names=list(columns))


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with repeated passages removed from text: kept words joined by one space; texts that lose nothing stay as they
    are. An n_chars column follows the text; all other columns are carried."""
    own = keyed(docs, F.col("doc_id").cast("long"))
    spans = by_place(repeated_spans(own.filter("doc is not null"), width), "size").withColumnRenamed("entries", HELD)
    here = (F.col("doc_id").cast("long") == spans["doc"]) & (F.shiftrightunsigned(F.xxhash64("text"), 33) == spans["row"])
    return docs.join(spans, here, "left").select(*(docs[c] for c in docs.columns), HELD).mapInArrow(_rewrite, docs.schema)
