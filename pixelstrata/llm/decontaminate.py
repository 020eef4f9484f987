"""Benchmark decontamination by size-partitioned MinHash containment search, with exact shingle containment.

The containment of a short item in a long document is the chance that an item's minimum under a random hash is a shingle
of the document, whatever the document's size: the document needs no sketch of its own, only membership. Items are
partitioned by size (powers of two of their shingle count). A partition has its own number of minima and its own number of
them that a document must hold to be a candidate: a quarter of the largest size plus one minima, of which one must be met, up to
sizes of 63, where nothing can be missed below 61; SKETCH minima beyond, of which so many must be met that an item at the
threshold is missed with a probability of at most MISS (a binomial tail). Every partition has an index of its own (minimum to
items); every document's shingles are held against all of them in one pass, and
exact containment on full sets decides.

The indexes and the items' sets are broadcast only while the benchmark has at most ITEM_SHINGLES shingles (counted
first); a larger one is cut by item into slices of that bound, each searched in a pass of its own.

Defined cases: null or wordless texts have no shingles, contain nothing and, as items, are found nowhere; texts under five
words are one shingle; repeated item_ids count as separate rows and give one result for each distinct text; repeated
documents return a row each; null ids are carried and ids keep their type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import drop_staged, staged
from .textkernels import blocks, mix, shingles, word_hashes

SKETCH, MISS = 32, 1e-9
ITEM_SHINGLES = 2_000_000
BITS = 22  # of the table that most shingles of documents are rejected by


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            hashes, begin = shingles(*word_hashes(data, offsets, lower=True), k)
            sets = [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(batch.num_rows)]
            yield pa.record_batch(
                [batch.column("item_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["item_id", "n", "members"]
            )

    return run


def partition(size: int) -> int:
    """The partition of an item of that many shingles: sizes from 2**p up to 2**(p + 1) - 1."""
    return size.bit_length() - 1


def plan(p: int, percent: int = 75) -> tuple[int, int]:
    """The number of minima of the items of partition p, and how many of them a candidate must hold."""
    misses = (2 ** (p + 1) - 1) * (100 - percent) // 100
    if misses < SKETCH // 2:
        return misses + 1, 1
    share = percent / 100
    tail, least = 0.0, 0
    while True:
        tail += comb(SKETCH, least) * share**least * (1 - share) ** (SKETCH - least)
        if tail > MISS:
            return SKETCH, max(least, 1)
        least += 1


def minima(members: np.ndarray, count: int) -> np.ndarray:
    """An item's sketch: the `count` shingles (or all) that are smallest under a hash function."""
    if len(members) <= count:
        return members
    return members[np.argpartition(mix(members ^ np.uint64(0xD6E8FEB86659FD93)), count - 1)[:count]]


class Index:
    """The sketches of a bounded number of items, partition by partition, and their full sets."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int = 75):
        held = [i for i in range(len(sets)) if len(sets[i])]
        self.ids, self.sets = [ids[i] for i in held], [sets[i] for i in held]
        own = np.array([partition(len(s)) for s in self.sets], np.int64)
        self.table = np.zeros(1 << BITS, np.uint64)  # a bit for each partition that has a minimum there
        self.parts = []
        for p in np.unique(own).tolist():
            count, least = plan(p, percent)
            items = np.flatnonzero(own == p)
            sketches = [minima(self.sets[i], count) for i in items]
            keys, owner = np.concatenate(sketches), np.repeat(items, [len(s) for s in sketches])
            by = np.argsort(keys, kind="stable")
            # an item that is smaller than its sketch can only be asked for as many
            need = np.minimum(least, np.array([max(1, -(-len(s) * percent // 100)) for s in self.sets]))
            self.parts.append((np.uint64(1 << p), keys[by], owner[by], need))
            np.bitwise_or.at(self.table, (keys >> np.uint64(64 - BITS)).astype(np.int64), np.uint64(1 << p))

    def candidates(self, hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (row, item) whose minima the rows begin[i]:begin[i+1] of hashes hold in the number that their partition asks for."""
        marks = self.table[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]
        out = [np.zeros((0, 2), np.int64)]
        for bit, keys, items, need in self.parts:
            at = np.flatnonzero(marks & bit)
            lo, hi = (np.searchsorted(keys, hashes[at], side) for side in ("left", "right"))
            n = hi - lo
            at = np.repeat(at, n)
            place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.searchsorted(begin, at, "right") - 1
            met = np.unique(np.stack([row, items[place], hashes[at].view(np.int64)], 1), axis=0)[:, :2]
            pairs, count = np.unique(met, axis=0, return_counts=True)
            out.append(pairs[count >= need[pairs[:, 1]]])
        found = np.concatenate(out)
        return found[np.lexsort((found[:, 1], found[:, 0]))]


def contaminations(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the items of which a document holds `percent` of the shingles."""
    spark = docs.sparkSession
    items = staged(
        benchmark.select("item_id", "text")
        .mapInArrow(_item_sets(k), f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, n long, members binary").distinct()
    )
    total = items.agg(F.sum("n")).first()[0] or 0
    slices = -(-total // ITEM_SHINGLES) or 1
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"]
    found = None
    for part in range(slices):
        own = items.filter(F.pmod(F.xxhash64("members"), F.lit(slices)) == part).orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(Index([r.item_id for r in own], [np.frombuffer(r.members, np.uint64) for r in own], percent))
        hits = docs.select("doc_id", "text").mapInArrow(
            _search(index, to_arrow_type(item.dataType), percent, k),
            f"doc_id {kind}, item_id {item.dataType.simpleString()}, n_item long, n_shared long, containment double"
        )
        found = hits if found is None else found.union(hits)
    drop_staged(items)
    return found


def _search(index, item_type: pa.DataType, percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch, data, offsets in blocks(batches):
            hashes, begin = shingles(*word_hashes(data, offsets, lower=True), k)
            pairs = own.candidates(hashes, begin)
            rows, ids, sizes, shared = [], [], [], []
            last, members = -1, None
            for r, i in pairs.tolist():
                if r != last:
                    last, members = r, np.unique(hashes[begin[r] : begin[r + 1]])
                wanted = own.sets[i]
                place = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
                n = int((members[place] == wanted).sum())
                if 100 * n >= percent * len(wanted):
                    rows.append(r)
                    ids.append(own.ids[i])
                    sizes.append(len(wanted))
                    shared.append(n)
            share = [a / b for a, b in zip(shared, sizes, strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, item_type), pa.array(sizes, pa.int64()),
                    pa.array(shared, pa.int64()), pa.array(share, pa.float64())
                ],
                names=["doc_id", "item_id", "n_item", "n_shared", "containment"]
            )

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """The rows of docs that hold no item, all columns kept; rows with a null doc_id stay."""
    found = contaminations(docs, benchmark, percent, k).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
