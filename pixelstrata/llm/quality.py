"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= g) = 1 / (1 + exp(score - threshold[g])): one set of weights, shared by all grades, and ordered thresholds. A
text's features are the distinct hashed words (A-Z lower-cased), their starts (START bytes of longer words), the shapes of its words (runs of upper, lower, digit and
each other character collapsed: "THE!!" is A!), each shape's share of the words by powers of two, and the share
of words that repeat the one before. Features count once a text, so one insult in a long document weighs as much as in a
short one. Only features that are more frequent in lower grades have a weight, so a text without any gets the best score.

The fit uses at most SAMPLE labelled rows (those of smallest hash of doc_id); grades come from labels: 0 for low quality,
1 for good but toxic, 2 for good. Every document is scored on its whole text in one pass that carries only the weights.

Defined cases: labels with a null doc_id or quality, and labels of unknown documents, are ignored, a null toxic counts as 0;
of repeated labels the lowest grade holds; with fewer than two grades there is nothing to learn and all
documents get a tail probability of 1; null or empty texts have no features and keep the best score; repeated rows and null
doc_ids return their rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import LOWER, blocks, mix, span_hashes, words

SAMPLE, LEAST, SIGNAL = 20_000, 5, 4.5  # labelled rows; texts a feature must be in; deviations it must differ by
BITS, START = 20, 5
KEEP = 0.7  # held-out: 99.9 % of clean, 14 % of toxic and 0.2 % of low-quality texts reach it
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of each feature of each row; a pair may repeat for words."""
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    word = span_hashes(LOWER[data], starts, ends)
    longer = np.flatnonzero(ends - starts > START)
    stem = mix(span_hashes(LOWER[data], starts[longer], starts[longer] + START) + np.uint64(3))
    kind = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = mix(span_hashes(kind[keep], at[starts], at[ends]) + np.uint64(1))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    owner = row[longer]
    rows = np.concatenate([row, row[again]])
    marks = np.concatenate([shape, np.full(int(again.sum()), 7, np.uint64)])
    by = np.lexsort((marks, rows))
    rows, marks = rows[by], marks[by]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (marks[1:] != marks[:-1])
    place = np.flatnonzero(new)
    count = np.diff(np.append(place, len(rows)))
    rows, marks = rows[place], marks[place]
    level = np.floor(np.log2(np.diff(first)[rows] / count)).astype(np.uint64)
    made = np.concatenate([word, stem, marks, mix(marks + (level + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))])
    return np.concatenate([row, owner, rows, rows]), (made >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ordinal:
    """Weights by feature number and ordered thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, feature = features(data, offsets)
        weighed = self.weights[feature] != 0
        pairs = np.unique(row[weighed] << BITS | feature[weighed])
        return np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], n) if len(pairs) else np.zeros(n)

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= g) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds, -50, 50)))


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, rounds: int = 400) -> Ordinal:
    """From distinct (row, feature) pairs and the rows' grades (0, 1, ...), by AdaGrad on the whole sample."""
    n, size = len(grade), 1 << BITS
    levels = int(grade.max(initial=0))
    weights = np.zeros(size)
    if not n or len(np.unique(grade)) < 2:
        return Ordinal(weights, np.zeros(0))
    seen = np.bincount(feature, minlength=size)
    signal = np.zeros(size)
    for g in range(levels):
        low = grade <= g
        if 0 < low.sum() < n:
            inside, share = np.bincount(feature[low[row]], minlength=size), low.mean()
            spread = np.sqrt(np.maximum(seen, 1) * share * (1 - share) * (1 - seen / n) + 1e-9)
            signal = np.maximum(signal, (inside - seen * share) / spread)
    names = np.flatnonzero((seen >= LEAST) & (signal >= SIGNAL))
    number = np.full(size, -1)
    number[names] = np.arange(len(names))
    used = number[feature] >= 0
    row, column = row[used], number[feature[used]]
    own = np.zeros(len(names))
    cut = np.array([np.log((np.mean(grade <= g) + 1e-3) / (np.mean(grade > g) + 1e-3)) for g in range(levels)])
    step_w, step_t = np.full(len(names), 1e-8), np.full(levels, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, own[column], n) if len(row) else np.zeros(n)
        upper = np.append(cut, np.inf)[grade] - score
        lower = np.concatenate([[-np.inf], cut])[grade] - score
        up, down = 1 / (1 + np.exp(-np.clip(upper, -50, 50))), 1 / (1 + np.exp(-np.clip(lower, -50, 50)))
        up[np.isposinf(upper)], down[np.isneginf(lower)] = 1, 0
        mass = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / mass, down * (1 - down) / mass
        slope = (d_up - d_down) / n
        g_w = (np.bincount(column, slope[row], len(names)) if len(row) else own) + 1e-5 * own
        g_t = -(np.bincount(grade, d_up, levels + 1)[:levels] - np.bincount(grade, d_down, levels + 1)[1:]) / n
        step_w += g_w**2
        step_t += g_t**2
        own -= 0.3 * g_w / np.sqrt(step_w)
        cut = np.sort(cut - 0.1 * g_t / np.sqrt(step_t))
    weights[names] = own
    return Ordinal(weights, cut)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches):
        row, feature = features(data, offsets)
        pairs = np.unique(row << BITS | feature)
        ids, grades = np.asarray(batch.column("doc_id")), np.asarray(batch.column("grade"))
        yield pa.record_batch(
            [pa.array(ids[pairs >> BITS]), pa.array(grades[pairs >> BITS]), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32))],
            names=["doc_id", "grade", "feature"]
        )


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of labels (doc_id, quality, toxic) on docs (doc_id, text).

    Features are counted by grade and chosen before anything reaches the driver, which gets the chosen ones' pairs only."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").groupBy("doc_id").agg(
        F.first("grade").alias("grade"), F.min("text").alias("text")
    ).persist()
    rows = texts.select("doc_id", "grade").orderBy("doc_id").toArrow()
    ids, grades = rows["doc_id"].to_numpy(), rows["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        texts.unpersist()
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), grades)
    pairs = texts.mapInArrow(_pairs, "doc_id long, grade int, feature int")
    low = {f"low{g}": F.sum((F.col("grade") <= g).cast("double")) for g in range(int(grades.max()))}
    counts = pairs.groupBy("feature").agg(F.count("*").cast("double").alias("seen"), *(v.alias(k) for k, v in low.items()))
    total = len(grades)
    signals = []
    for g, name in enumerate(low):
        share = float((grades <= g).mean())
        spread = F.sqrt(F.col("seen") * (share * (1 - share)) * (1 - F.col("seen") / total) + 1e-9)
        signals.append((F.col(name) - F.col("seen") * share) / spread)
    strongest = F.greatest(*signals) if len(signals) > 1 else signals[0]
    useful = counts.filter((F.col("seen") >= LEAST) & (strongest >= SIGNAL)).select("feature")
    found = pairs.join(useful, "feature").select("doc_id", "feature").toArrow()
    texts.unpersist()
    row = np.searchsorted(ids, found["doc_id"].to_numpy())
    return fit(row, found["feature"].to_numpy().astype(np.int64), grades)


def graded(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, expected_grade, p_top, kept) for each row of docs: p_top is the probability of the highest grade."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ordinal = held.value
        for batch, data, offsets in blocks(batches):
            scores = own.scores(data, offsets)
            below = own.at_most(scores)
            top = 1 - below[:, -1] if below.shape[1] else np.ones(len(scores))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(scores), pa.array((1 - below).sum(1)), pa.array(top), pa.array(top >= keep)],
                names=["doc_id", "score", "expected_grade", "p_top", "kept"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, p_top double, kept boolean")


def selected(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """The rows of docs whose probability of the highest grade reaches `keep`, all columns kept, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ordinal = held.value
        for batch, data, offsets in blocks(batches):
            below = own.at_most(own.scores(data, offsets))
            top = 1 - below[:, -1] if below.shape[1] else np.ones(batch.num_rows)
            yield batch.filter(pa.array(top >= keep))

    return docs.mapInArrow(run, docs.schema)
