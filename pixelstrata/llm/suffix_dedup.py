"""Exact substring deduplication of bytes by blockwise suffix sorting with a difference cover.

A byte goes if a `width`-byte string that covers it also starts anywhere else, in any document. Such strings have equal
anchors at equal places (see repeats), so suffixes need sorting only against suffixes of one bucket: those that start the
same distance before an occurrence of one anchor. Contexts that are copies as a whole go without sorting; the contexts of
an anchor that differ are laid out in a block of bounded size, anchors aligned to the cover's period, and sorted one
bucket at a time. Suffixes are compared by their first bytes and, for the long ties that share the anchor, by ranks
of the sample positions of a difference cover, computed once for the block by doubling (32, 64, 128 bytes). So memory is
that of a block, whatever the length of the ties; equal neighbours at `width` bytes are repeats.

An anchor of over GROUP differing contexts (a passage at the edges of which a third of all documents differ) does not
go to one task: its contexts are dealt to deeper anchors, of which each is a bucket range of its own, until each is within that bound.

Defined cases: null or empty texts have 0 bytes and the digest of nothing; matches never cross documents; repeated rows of a doc_id, of equal or other
texts, are places of their own, so all of a repeated text of `width` bytes or more goes; rows with a null doc_id take part and return their row;
strings are judged on the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import groups
from .repeats import by_place, contexts, covered, entries, halves, keyed, shared, split_side, staged_runs
from .tables import drop_staged, staged
from .textkernels import blocks

GRAM, GROUP, BLOCK_BYTES = 40, 400, 2 << 20
PERIOD = 32
#: Every difference modulo PERIOD is one of two members: 0..5 minus 5, 11, 17, 23, 29.
COVER = np.array([*range(6), *range(11, 30, 6)])
_SAMPLE = np.zeros(PERIOD, bool)
_SAMPLE[COVER] = True
#: For each residue, the distance to the next sample position, and back to the last.
_NEXT = np.array([next(d for d in range(PERIOD) if _SAMPLE[(r + d) % PERIOD]) for r in range(PERIOD)])
_BACK = np.array([next(d for d in range(PERIOD) if _SAMPLE[(r - d) % PERIOD]) for r in range(PERIOD)])


def dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by the keys (first key first) and each row's dense rank, from 1."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        held = k[order]
        new[1:] |= held[1:] != held[:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(new) + 1
    return order, rank


def sample_ranks(text: np.ndarray, eight: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Ranks of the sample positions by their first 32, 64 and 128 bytes, by position."""
    at = np.flatnonzero(_SAMPLE[np.arange(size) % PERIOD])
    ranks, reach = {}, 32
    own = dense(*(eight[at + d] for d in (0, 8, 16, 24)))[1]
    while True:
        held = np.zeros(len(text), np.int32)
        held[at] = own
        ranks[reach] = held
        if reach == 128:
            return ranks
        own = dense(own, held[at + reach])[1]
        reach *= 2


def repeated_windows(contexts: list[np.ndarray], anchors: np.ndarray, bucket: np.ndarray, width: int) -> list[np.ndarray]:
    """For each context, which of its windows also stand in another place of the block. anchors: the anchor's place
    in each context; bucket: the number of the anchor."""
    sizes = np.array([len(c) for c in contexts])
    at, begins = 0, []
    for size, anchor in zip(sizes, anchors, strict=True):
        at += (-(at + anchor)) % PERIOD
        begins.append(at)
        at += size
    text = np.zeros(at + 8 * PERIOD, np.uint8)
    for b, c in zip(begins, contexts, strict=True):
        text[b : b + len(c)] = c
    eight = text.astype(np.uint64)
    for step in (1, 2, 4):
        eight = np.concatenate([(eight[:-step] << np.uint64(8 * step)) | eight[step:], np.zeros(step, np.uint64)])
    ranks = sample_ranks(text, eight, at)
    number = sizes - width + 1
    begins = np.array(begins)
    first = np.cumsum(number) - number
    start = np.repeat(begins - first, number) + np.arange(number.sum())
    before = np.repeat(anchors + begins, number) - start
    where = bucket.repeat(number) * (2 * width) + before
    sample = start + _NEXT[start % PERIOD]
    end = start + width - 64
    late = end - _BACK[end % PERIOD]
    keys = (where, eight[start], ranks[128][sample], ranks[32][sample + 128], ranks[64][late], eight[start + width - 8])
    rank = dense(*keys)[1]
    return np.split(np.bincount(rank)[rank] > 1, np.cumsum(number)[:-1])


def _sorted_blocks(width: int):
    """Rows (g, doc, at, p, times, body), by g: (doc, at, size) of what repeats in contexts that occur once."""

    def settle(held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        bodies = [np.frombuffer(s.as_buffer(), np.uint8) for s in rows["body"]]
        bucket = np.repeat(np.arange(len(held)), [t.num_rows for t in held])
        once = rows["times"].to_numpy() == 1
        out: list[tuple[int, int, int]] = []
        for doc, at, single, hit in zip(
            rows["doc"].to_pylist(), rows["at"].to_pylist(), once, repeated_windows(bodies, rows["p"].to_numpy(), bucket, width),
            strict=True
        ):
            if single and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out += [(doc, at + x, y - 1 + width - x) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        x = np.array(out, np.int64).reshape(-1, 3)
        return pa.record_batch([pa.array(x[:, j]) for j in range(3)], names=["doc", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in groups(batches, "g"):
            held.append(group)
            size += group["body"].nbytes
            if size > BLOCK_BYTES:
                yield settle(held)
                held, size = [], 0
        if held:
            yield settle(held)

    return run


def _judged(rows: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (g, c, doc, at, n, p; times: how often a row's context stands, 1 without the column): those whose class stands
    more often than once but the row itself does not, and one row of each class of a group whose k classes are to be sorted;
    and the staged table of both. several: all rows of groups that have more than one, at least."""
    times = F.sum("times") if "times" in rows.columns else F.count("*")
    own = F.col("times") if "times" in rows.columns else F.lit(1)
    classes = staged(several.groupBy("g", "c").agg(times.alias("total"), *(F.first(x).alias(f"first_{x}") for x in ("doc", "at"))))
    sizes = classes.groupBy("g").agg(F.count("*").alias("k"), F.min("total").alias("fewest"))
    sizes = sizes.filter("k > 1 and fewest = 1").select("g", "k")
    known = rows.withColumn("times", own.cast("long")).join(classes.join(split_side(sizes, "k"), "g", "left"), ["g", "c"], "left")
    out = staged(known.filter("coalesce(total > times and times = 1, false) or coalesce(k > 1 and doc = first_doc and at = first_at, false)"))
    drop_staged(classes)
    whole = out.filter("total > times and times = 1").select("doc", "at", "n")
    kept = out.filter("k > 1 and doc = first_doc and at = first_at").withColumn("times", F.col("total"))
    return whole, kept.drop("c", "total", "first_doc", "first_at"), out


def repeated_ranges(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc, at, size): byte ranges of docs (doc, row, text) that go, staged; their union is what goes."""
    whole_size = F.expr(f"cast(n + {width} - 1 as bigint)").alias("size")
    runs = staged_runs(docs, "bytes", width, GRAM)
    several = shared(runs, "places > 1")
    whole, kept, judged = _judged(runs, several)
    drop_staged(runs, several)
    found = [whole.select("doc", "at", whole_size)]
    held = contexts(docs, kept, "bytes", width, GRAM)
    made = [judged, held]
    while True:
        small = held.filter(F.col("k") <= GROUP).select("g", "doc", "at", "p", "times", "body").repartition("g").sortWithinPartitions("g")
        found.append(small.mapInArrow(_sorted_blocks(width), "doc long, at long, size long"))
        large = held.filter(F.col("k") > GROUP)
        if large.isEmpty():
            break
        parts = halves(large, "bytes", width)
        whole, held, judged = _judged(parts, parts)
        drop_staged(parts)
        found.append(whole.select("doc", "at", whole_size))
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
            at, (lo, size) = entries(batch, "lo", "size")
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            gone = covered(len(data), lo + offsets[row], lo + size + offsets[row])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            cuts = offsets[1:-1][offsets[1:-1] < len(data)]
            begins[cuts] = gone[cuts]
            removed, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins))
            left = data[~gone].tobytes()
            size = offsets - removed
            out = [left[size[i] : size[i + 1]] for i in range(batch.num_rows)]
            last = pa.array(out, pa.binary()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), last],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return run


def suffix_dedup(docs: DataFrame, width: int = 200, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs: the bytes kept, or (texts=False) their sha256."""
    own = keyed(docs, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "doc_id")
    spans = by_place(repeated_ranges(own.select("doc", "row", "text"), width), "size")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.join(spans, ["doc", "row"], "left").mapInArrow(
        _clean(texts), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}"
    )
