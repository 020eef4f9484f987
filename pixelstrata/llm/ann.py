"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as a sum of BOOKS full-dimensional codewords, one of each residual codebook. Codebooks start as
k-means of residuals and are refined by least squares over beam-search codes. Codes are found by beam search: the
BEAM best partial sums go on at each book, scored with inner products that are computed once. The reconstruction's norm is stored
with the code, so a query's tables (inner products with all codewords) give the cosine to each row's reconstruction by BOOKS
look-ups and one division. The cosine between row and reconstruction is stored too: angles obey the triangle inequality, so
the two bound the true cosine from above. Every row whose bound reaches the query's (k + 1)-th best exact score so far is
scored exactly, in double precision, on the original vectors; no number of candidates is fixed, and no neighbour is lost at any size.

Equal vectors are one row of the index (with their smallest `k + 1` ids, all that a result of k can name), so a vector that
is repeated a million times is one code and no hot group. Codebooks are fitted on at most SAMPLE vectors (those of
smallest hash); every vector is indexed. Where the codes separate little (no structure, or groups of near copies) more rows
are scored exactly, by one matrix product a chunk. Queries come in blocks of QUERIES rows, each held against all codes. Rows
are sorted by code, so that a chunk of them is a cell of the first books: a query looks into a chunk only if the angle to its
mean direction, less the chunk's widest, can reach the best so far. On vectors with structure that leaves few chunks; on vectors
without any (the tables here) it leaves all, and no index by cells could reach the asked recall with less.

Defined cases: null or empty vectors, vectors that hold null or non-finite components, zero vectors and null ids take no part;
neither do vectors whose dimension is not the most common one (the larger of equally common ones); repeated rows of an
id count once; an empty table gives no rows; fewer than k candidates give all; ties go to the smaller id; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop_staged, staged

BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 3, 1
SAMPLE, QUERIES, CHUNK, PAIRS = 10_000, 2048, 2048, 16_384
RIDGE = 1e-2
#: Reconstructions of a smaller norm bound nothing: their rows are always scored.
SHORT = 0.1


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls and of one length."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def level(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which leave scores as they are to the last bit and squares finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def nearest_word(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * x @ book.T).argmin(1)


def sums_by(code: np.ndarray, x: np.ndarray, words: int) -> np.ndarray:
    """The sum of the rows of x for each code."""
    out = np.zeros((words, x.shape[1]))
    order = np.argsort(code, kind="stable")
    held, first = np.unique(code[order], return_index=True)
    out[held] = np.add.reduceat(x[order], first)
    return out


def k_means(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    book = x[rng.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        code = nearest_word(x, book)
        n, sums = np.bincount(code, minlength=words), sums_by(code, x, words)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=words)])
    return book


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (one byte a book) by beam search."""
    count, words, _ = books.shape
    flat = books.reshape(count * words, -1)
    gram = (flat @ flat.T).reshape(count * words, count, words)
    out = np.zeros((len(x), count), np.uint8)
    for lo in range(0, len(x), 1024):
        own = x[lo : lo + 1024]
        n = len(own)
        inner = (own @ flat.T).reshape(n, count, words)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
        for m in range(count):
            norms = np.einsum("wd,wd->w", books[m], books[m])
            more = cost[:, :, None] + (norms - 2 * inner[:, m])[:, None, :]
            for j in range(m):
                more += 2 * gram[codes[:, :, j] + j * words, m]
            keep = min(beam, more.shape[1] * words)
            more = more.reshape(n, -1)
            best = np.argpartition(more, keep - 1, 1)[:, :keep]
            cost = np.take_along_axis(more, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None]], 2)
        out[lo : lo + n] = codes[np.arange(n), cost.argmin(1)]
    return out


def fit(x: np.ndarray, count: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (count, words, dimensions) for unit vectors."""
    rng = np.random.default_rng(0)
    left, books = x.copy(), []
    for _ in range(count):
        book = k_means(left, words, rng)
        left -= book[nearest_word(left, book)]
        books.append(book)
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books).astype(np.int64) + np.arange(count) * words
        gram = np.zeros((count * words, count * words), np.float32)
        for a in range(count):
            for b in range(count):
                pair = np.bincount((codes[:, a] % words) * words + codes[:, b] % words, minlength=words * words)
                gram[a * words : (a + 1) * words, b * words : (b + 1) * words] = pair.reshape(words, words)
        sums = np.concatenate([sums_by(codes[:, a] % words, x, words) for a in range(count)])
        gram[np.arange(len(gram)), np.arange(len(gram))] += np.float32(RIDGE)
        goal = (sums + RIDGE * books.reshape(len(gram), -1)).astype(np.float32)
        books = np.linalg.solve(gram, goal).astype(np.float64).reshape(books.shape)
        del gram
    return books


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def valid(vectors: DataFrame) -> DataFrame:
    """(id, v) of rows that can take part, v as doubles; one row for each id."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = plain.filter("id is not null and size(v) > 0").filter(F.forall("v", finite) & F.exists("v", lambda c: c != 0))
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return usable.filter(F.size("v") == (lengths.d if lengths else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _encode(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = level(matrix(batch.column("v")))
                x = unit(v)
                codes = encode(x, books.value)
                made = decode(codes, books.value)
                norms = np.sqrt((made * made).sum(1))
                held = np.where(norms < SHORT, -1.0, (x * made).sum(1) / np.maximum(norms, SHORT))
                raw = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (v, codes)]
                yield pa.record_batch(
                    [batch.column("class"), *raw, pa.array(norms), pa.array(np.clip(held, -1, 1))],
                    names=["class", "v", "code", "norm", "held"]
                )

    return run


def cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows a of x with the rows b of y: sums in extended precision, rounded to doubles once, so that vectors of one direction
    tie whatever their lengths."""
    out = np.empty(len(a))
    for lo in range(0, len(a), PAIRS):
        p, q = x[a[lo : lo + PAIRS]].astype(np.longdouble), y[b[lo : lo + PAIRS]].astype(np.longdouble)
        out[lo : lo + PAIRS] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
    return out


def reaching(near: np.ndarray, held: np.ndarray, least: np.ndarray, slack: float) -> np.ndarray:
    """Where a row (near: the cosine of its reconstruction with the query; held: with the row itself) can have a cosine
    of `least`: where the angles' difference is no more than that of `least`."""
    c, t = held.astype(np.float32)[:, None], least.astype(np.float32)[None]
    cut = c * t - np.sqrt(1 - c * c) * np.sqrt(np.maximum(1 - t * t, 0))
    return (near >= cut - np.float32(slack)) | (t <= -c)


def in_reach(x: np.ndarray, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The queries that some row of x can be as near to as `least`: those whose angle to the rows' mean direction, less the widest
    angle of a row to it, is no more than that of `least`."""
    mean = x.sum(0)
    length = np.sqrt((mean * mean).sum())
    if length < 1e-9 * len(x):
        return np.arange(len(queries))
    mean /= length
    angle = lambda c: np.arccos(np.clip(c, -1.0, 1.0))
    return np.flatnonzero(angle(queries @ mean) - angle((x @ mean).min()) <= angle(least) + 1e-6)


def _scan(books, queries, k: int):
    """(query, class, score): the best k + 1 classes of this task for each query of the block, by exact score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        u = unit(q) if len(q) else q
        tables = np.ascontiguousarray(np.einsum("mwd,qd->mwq", books.value, u).astype(np.float32))
        # the rounding of a sum of look-ups in single precision, at the smallest norm
        slack = 1e-6 + len(tables) * 2.0**-23 * np.sqrt((books.value**2).sum(2)).max(1).sum() / SHORT
        least = np.full(len(ids), -1.0)
        of, who, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def add(rows, at, v, classes):
            nonlocal of, who, score
            of, who = np.concatenate([of, at]), np.concatenate([who, classes[rows]])
            score = np.concatenate([score, cosines(v, q, rows, at)])
            order = np.lexsort((who, -score, of))
            of, who, score = of[order], who[order], score[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            least[of[rank == k]] = score[rank == k]
            of, who, score = of[rank <= k], who[rank <= k], score[rank <= k]

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                v = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(part.num_rows, -1)
                classes = np.asarray(part.column("class"))
                asked = in_reach(unit(v), u, least) if len(of) else np.arange(len(ids))
                if not len(asked):
                    continue
                near = tables[0][:, asked][codes[:, 0]]
                for m in range(1, codes.shape[1]):
                    near += tables[m][:, asked][codes[:, m]]
                near /= np.maximum(np.asarray(part.column("norm")), SHORT).astype(np.float32)[:, None]
                fresh = np.ones(near.shape, bool)
                if not len(of):
                    count = min(k + 1, part.num_rows)
                    lead = np.argpartition(-near, count - 1, 0)[:count]
                    np.put_along_axis(fresh, lead, False, 0)
                    add(lead.ravel(), np.tile(np.arange(len(ids)), count), v, classes)
                fresh &= reaching(near, np.asarray(part.column("held")), least[asked], slack)
                if fresh.sum() * 32 > fresh.size:
                    fresh &= unit(v) @ u[asked].T >= least[asked] - 1e-9
                rows, at = np.nonzero(fresh)
                if len(rows):
                    add(rows, asked[at], v, classes)
        yield pa.record_batch([pa.array(ids[of]), pa.array(who), pa.array(score)], names=["query", "class", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors (vec_id, embedding), itself
    excluded by id."""
    spark = vectors.sparkSession
    rows = staged(valid(vectors))
    salted = Window.partitionBy("v", F.pmod("id", F.lit(64))).orderBy("id")
    fewest = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).drop("r")
    same = Window.partitionBy("v").orderBy("id")
    fewest = fewest.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    classes = staged(fewest.groupBy("v").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids")))
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    asked = staged(queries.select(F.col("vec_id").cast("long").alias("id")).distinct().join(rows, "id"))
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    x = unit(matrix(sample))
    books = spark.sparkContext.broadcast(fit(x, words=min(WORDS, max(1, len(x)))))
    codes = staged(classes.select("class", "v").mapInArrow(_encode(books), "class long, v binary, code binary, norm double, held double"))
    blocks = -(-asked.count() // QUERIES)
    near = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        held = spark.sparkContext.broadcast((own["id"].to_numpy(), level(matrix(own["v"].combine_chunks())) if own.num_rows else np.zeros((0, x.shape[1]))))
        found = codes.sortWithinPartitions("code").mapInArrow(_scan(books, held, k), "query long, class long, score double")
        near = found if near is None else near.union(found)
    if near is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    picked = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    scored = picked.join(classes.select("class", "ids"), "class")
    drop_staged(rows)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = scored.select("query", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query")
    return named.select(F.col("query").alias("query_id"), F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
