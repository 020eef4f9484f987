"""MinHash near-duplicates by a multi-index Hamming join.

Every document has a signature of SYMBOLS b-bit MinHash symbols (b = 16) of its set of word shingles. The signature
is split into CHUNKS chunks of WIDTH symbols. By the pigeonhole principle two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) symbols have a chunk with at most ERRORS differing symbols; all ways to make the allowed errors
(the symbol sets that remain) are enumerated as keys, so every pair under that signature distance shares a key.
At a similarity of 0.75 a pair has no common key with a probability of 0.262**12 = 1e-7, less above it.

Pairs are never emitted. Equal sets collapse into one class first. The rows of a key are streamed through one task, which
walks from each class to the classes of the key within the signature distance FAR and emits one edge for each class it
reaches; components of these edges are families: every pair that could be a link is inside one. Within a family, exact links are
walked the same way on full sets (counts of shared shingles from postings), again with one edge for each class reached.
Components of the exact edges are the result.

Large groups: the members of a family of over BLOCK shingles, and of a key of over KEY_ROWS classes, are first held against one
pivot, the smallest member, by a join that can be split. Where the pivot reaches all, which a group of copies of one text
mostly does, that is all. Else members that it reached and members that it did not are dealt to blocks, and the tasks are pairs
of blocks, of which one at least holds members that were not reached: two members that the pivot reached need no look at each other.
So the work of a tight group is linear, no task holds more than two blocks, and only what the pivots do not reach costs its square.

Defined cases: null or wordless texts have no shingles, keep their own component and link with nothing; repeated rows
of a doc_id, of equal or other texts, are one node, which links with whatever one of its sets links with, and each
returns its row; rows with a null doc_id take the component of the class they belong
to (null without one) and are kept only in that case; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import drop_staged, staged
from .textkernels import blocks, mix, shingles, word_hashes

CHUNKS, WIDTH, ERRORS = 12, 4, 1
SYMBOLS = CHUNKS * WIDTH
FAR = 29  # pairs that differ in more symbols are no candidates: over 5.5 deviations from the mean at a similarity of 0.75
KEY_ROWS = 2000  # classes of a key in one task, and of a block of a larger key
BLOCK = 100_000  # shingles of a family in one task, and of a block of a larger family
LANES = SYMBOLS // 4  # a signature is kept as longs of four 16-bit symbols
_SEEDS = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x51ED270B27F5C9A1))
_MULTIPLY = (_SEEDS[:SYMBOLS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[SYMBOLS:] >> np.uint64(32)).astype(np.uint32)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit MinHash symbols of a non-empty set of 64-bit hashes."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        np.minimum(least, (x[lo : lo + 4096, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            hashes, begin = shingles(*word_hashes(data, offsets, lower=True), k)
            n = batch.num_rows
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            signs = np.zeros((n, SYMBOLS), np.uint16)
            for i in range(n):
                if begin[i + 1] > begin[i]:
                    own = np.unique(hashes[begin[i] : begin[i + 1]])
                    size[i], one[i], two[i] = len(own), own.sum(), (own * (own >> np.uint64(7) | np.uint64(1))).sum()
                    signs[i] = signature(own)
            lanes = signs.view(np.int64)
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    *(pa.array(np.ascontiguousarray(lanes[:, j])) for j in range(LANES))
                ],
                names=["doc_id", "n", "h1", "h2", *_lanes()]
            )

    return run


def _lanes() -> list[str]:
    return [f"s{j}" for j in range(LANES)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep): each chunk without each choice of ERRORS symbols; the key holds the choice and the symbols left."""
    left = list(combinations(range(WIDTH), WIDTH - ERRORS))
    for batch in batches:
        signs = np.ascontiguousarray(np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in _lanes()], 1)).view(np.uint16).astype(np.int64)
        rep = batch.column("rep").to_numpy(zero_copy_only=False)
        for chunk in range(CHUNKS):
            for j, symbols in enumerate(left):
                key = np.full(len(rep), chunk * len(left) + j, np.int64)
                for s in symbols:
                    key = (key << 16) | signs[:, chunk * WIDTH + s]
                yield pa.record_batch([pa.array(key), pa.array(rep)], names=["key", "rep"])


def walk(n: int, near, reached: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1; near(i, rest) says which of the places `rest` are adjacent to i. With `reached`, those
    are joined already, and only what can be reached from them is."""
    rest = np.arange(n) if reached is None else np.flatnonzero(~reached)
    queue = [] if reached is None else np.flatnonzero(reached).tolist()
    while len(rest):
        if not queue:
            if reached is not None:
                return
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        if not len(rest):
            return
        hit = near(i, rest)
        new = rest[hit]
        if len(new):
            rest = rest[~hit]
            yield from ((i, int(j)) for j in new)
            queue.extend(new.tolist())


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The consecutive rows that agree in the keys; batches come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1
        if held and (columns[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = columns[-1]
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _signs(table) -> np.ndarray:
    """The signatures of rows as (rows, SYMBOLS) symbols."""
    lanes = [np.asarray(table[x] if isinstance(table, pa.Table) else table.column(x)) for x in _lanes()]
    return np.ascontiguousarray(np.stack(lanes, 1)).view(np.uint16)


def _close(signs, n, sign, m, percent: int) -> np.ndarray:
    """Which signatures, of sets of size n, are near enough to one, of a set of size m."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((signs != sign).sum(1) <= FAR)


def _near(percent: int):
    """Rows (key, side, x, y, rep, n, linked, signature), by key and blocks: edges that join all classes of a task within FAR of each
    other; on side 1, all that can be reached from linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in groups(batches, "key", "side", "x", "y"):
            rep, n, signs = group["rep"].to_numpy(), group["n"].to_numpy(), _signs(group)
            linked = group["linked"].to_numpy() if group["side"][0].as_py() else None

            def near(i, rest):
                return _close(signs[rest], n[rest], signs[i], n[i], percent)  # noqa: B023

            out += [(int(rep[i]), int(rep[j])) for i, j in walk(len(rep), near, linked)]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _reached(percent: int):
    """Rows (key, rep, x, n, signature, pivot's size and signature) with linked: whether the key's pivot x is within FAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = np.ascontiguousarray(np.stack([np.asarray(batch.column(f"p{x}")) for x in _lanes()], 1)).view(np.uint16)
            linked = _close(_signs(batch), np.asarray(batch.column("n")), pivot, np.asarray(batch.column("pn")), percent)
            names = ["key", "rep", "x", "n", *_lanes()]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(linked)], names=[*names, "linked"])

    return run


def _tasks(rows: DataFrame, by: str, member: str, weight, size: int) -> DataFrame:
    """rows (by, member, linked, ...) of the groups that have members without a link to the pivot, once for each task that
    needs them: (side, x, y) is (0, i, j) for two blocks without links and (1, i, j) for a linked block i and one without, j."""
    total = lambda held: F.ceil(F.sum(F.when(held, weight).otherwise(0)) / size).cast("int")
    blocks_ = rows.groupBy(by).agg(total(F.col("linked")).alias("near"), total(~F.col("linked")).alias("rest")).filter("rest > 0")
    held = rows.join(blocks_, by)
    block = F.pmod(F.xxhash64(member), F.greatest(F.when(F.col("linked"), F.col("near")).otherwise(F.col("rest")), F.lit(1))).cast("int")
    count = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda i: i < F.col(n))
    task = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    of = F.when(F.col("linked"), F.transform(count("rest"), lambda j: task(1, F.col("block"), j))).otherwise(
        F.concat(
            F.transform(count("rest"), lambda j: task(0, F.least("block", j), F.greatest("block", j))),
            F.transform(count("near"), lambda i: task(1, i, F.col("block"))),
        )
    )
    return held.withColumn("block", block).withColumn("task", F.explode(of)).select(*rows.columns, "task.side", "task.x", "task.y")


SETS = "family long, large boolean, id long, n long, linked boolean, members binary"


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            hashes, begin = shingles(*word_hashes(data, offsets, lower=True), k)
            rows = [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(batch.num_rows)]
            sizes, linked = pa.array([len(r) for r in rows], pa.int64()), pa.array(np.zeros(len(rows), bool))
            columns = [batch.column("family"), batch.column("large"), batch.column("doc_id"), sizes, linked, pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.record_batch(columns, names=["family", "large", "id", "n", "linked", "members"])

    return run


def _held_against_pivots(percent: int):
    """Rows of sets with their family's pivot, as rows of sets: linked says whether the exact link to the pivot is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, pivot = [], None, None
            for own, other in zip(batch.column("members"), batch.column("pivot"), strict=True):
                members = np.frombuffer(own.as_buffer(), np.uint64)
                raw = other.as_buffer()
                if last is None or raw != last:
                    last, pivot = raw, np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(pivot, members), max(len(pivot) - 1, 0))
                shared = int((pivot[at] == members).sum()) if len(pivot) else 0
                linked.append(100 * shared >= percent * (len(members) + len(pivot) - shared) and len(members) > 0)
            held = batch.drop_columns(["pivot"])
            yield held.set_column(held.schema.get_field_index("linked"), "linked", pa.array(linked, pa.bool_()))

    return run


class Postings:
    """The sets that hold each shingle, for counts of shared shingles; shingles of one set only are left out."""

    def __init__(self, sets: list[np.ndarray], places: np.ndarray):
        sizes = np.array([len(sets[i]) for i in places], np.int64)
        owner = np.repeat(places, sizes)
        values = np.concatenate([sets[i] for i in places]) if len(places) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.starts, self.counts = np.unique(values[order], return_index=True, return_counts=True)
        self.owner, self.size = owner[order], len(places)

    def shared(self, wanted: np.ndarray, n: int) -> np.ndarray:
        """How many of the wanted shingles each of n sets holds."""
        if not len(self.values):
            return np.zeros(n, np.int64)
        at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
        at = at[self.values[at] == wanted]
        counts = self.counts[at]
        return np.bincount(self.owner[np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())], minlength=n)


def exact_forest(sets: list[np.ndarray], percent: int, reached: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges that join all sets with 100 * shared >= percent * united, directly or through others; with `reached`, all that can be
    reached from those.

    Postings hold the sets that no edge has reached yet (made anew whenever those are half as many), so a set that is
    linked with most others costs one look at each, and what follows costs only what is left."""
    sizes = np.array([len(x) for x in sets])
    held = Postings(sets, np.arange(len(sets)) if reached is None else np.flatnonzero(~reached))

    def near(i, rest):
        nonlocal held
        if 2 * len(rest) <= held.size:
            held = Postings(sets, rest)
        shared = held.shared(sets[i], len(sets))[rest]
        return 100 * shared >= percent * (sizes[i] + sizes[rest] - shared)

    return walk(len(sets), near, reached)


def _confirm(percent: int):
    """Rows (family, side, x, y, id, linked, members), by family and blocks: the edges of each task's exact forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "family", "side", "x", "y"):
            held: dict[tuple[int, int], tuple[np.ndarray, bool]] = {}  # one for each id and text
            for i, m, linked in zip(group["id"].to_pylist(), group["members"], group["linked"].to_pylist(), strict=True):
                own = np.frombuffer(m.as_buffer(), np.uint64)
                if len(own):
                    held[i, int(own.sum())] = own, linked
            ids, sets = [i for i, _ in held], [own for own, _ in held.values()]
            linked = np.array([x for _, x in held.values()], bool) if group["side"][0].as_py() else None
            yield _edges([(ids[i], ids[j]) for i, j in exact_forest(sets, percent, linked) if ids[i] != ids[j]] if sets else [])

    return run


def _of_one_id(marks: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): edges between the classes (by their smallest doc_id) that hold the sets of one doc_id, and that doc_id."""
    marked = marks.filter("n > 0 and doc_id is not null")
    several = marked.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x < y").select("doc_id")
    classes = marked.join(several, "doc_id").join(reps.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"])
    return classes.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def _families(reps: DataFrame, percent: int) -> DataFrame:
    """(id, family): components of the classes that share a key and are within FAR, staged."""
    keys = reps.select("rep", *_lanes()).mapInArrow(_keys, "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count("*").alias("k")).filter("x < y").drop("y")
    dealt = staged(keys.join(shared, "key").join(reps.select("rep", "n", *_lanes()), "rep"))
    pivots = reps.select(F.col("rep").alias("x"), F.col("n").alias("pn"), *(F.col(x).alias(f"p{x}") for x in _lanes()))
    lanes = ", ".join(f"{x} long" for x in _lanes())
    large = dealt.filter(F.col("k") > KEY_ROWS).join(pivots, "x").mapInArrow(_reached(percent), f"key long, rep long, x long, n long, {lanes}, linked boolean")
    large = staged(large)
    names = ["key", "rep", "n", *_lanes(), "linked"]
    small = dealt.filter(F.col("k") <= KEY_ROWS).withColumn("linked", F.lit(False)).select(*names, *(F.lit(0).alias(x) for x in ("side", "x", "y")))
    tasks = small.union(_tasks(large.select(*names), "key", "rep", F.lit(1), KEY_ROWS)).repartition("key", "side", "x", "y")
    edges = tasks.sortWithinPartitions("key", "side", "x", "y").mapInArrow(_near(percent), "a long, b long")
    edges = edges.union(large.filter("linked and rep <> x").select(F.col("rep").alias("a"), F.col("x").alias("b")))
    families = staged(connected_components(edges).withColumnRenamed("component", "family"))
    drop_staged(dealt, large)
    return families


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); see the module's text."""
    marks = staged(
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_sign(k), "doc_id long, n long, h1 long, h2 long, " + ", ".join(f"{x} long" for x in _lanes()))
    )
    reps = staged(
        marks.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2")
        .agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in _lanes()))
    )
    families = _families(reps, percent)
    sizes = families.join(reps.select(F.col("rep").alias("id"), "n"), "id").groupBy("family").agg((F.sum("n") > BLOCK).alias("large"))
    owned = families.join(sizes, "family").withColumnRenamed("id", "doc_id").hint("merge")
    sets = staged(docs.select(F.col("doc_id").cast("long"), "text").join(owned, "doc_id").mapInArrow(_sets(k), SETS))
    large = sets.filter("large")
    pivots = large.filter("id = family").groupBy("family").agg(F.min("members").alias("pivot"))
    judged = staged(large.join(pivots, "family").select("*").mapInArrow(_held_against_pivots(percent), SETS))
    small = sets.filter("not large").select("*", *(F.lit(0).alias(x) for x in ("side", "x", "y")))
    tasks = small.union(_tasks(judged, "family", "id", F.col("n"), BLOCK)).repartition("family", "side", "x", "y")
    walked = tasks.sortWithinPartitions("family", "side", "x", "y").mapInArrow(_confirm(percent), "a long, b long")
    links = judged.filter("linked and id <> family").select(F.col("id").alias("a"), F.col("family").alias("b"))
    found = connected_components(links.union(walked).union(_of_one_id(marks, reps)))
    drop_staged(sets, judged, families)
    member = reps.select("n", "h1", "h2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "h1", "h2", F.coalesce("component", "rep").alias("component")
    )
    out = marks.select("doc_id", "n", "h1", "h2").join(member, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = staged(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))
    drop_staged(marks, reps)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one document of each component: its smallest doc_id, one row for each of that id's texts; rows with a null
    doc_id stay. All columns are carried."""
    kept = near_duplicates(docs, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))
