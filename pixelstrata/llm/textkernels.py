"""NumPy kernels over Arrow string columns: words, word hashes and shingles of whole texts.

A batch is cut into blocks of about BLOCK bytes (a longer text makes its own block), so memory depends on
the block or the longest text, never on the partition. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (UTF-8) or binary column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `size` bytes of text: the slice, its bytes, its offsets from 0."""
    for batch in batches:
        data, offsets = raw(batch.column(text))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which `inside` holds, cut at rows: starts, ends and the first run of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and apart."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * BLOCK, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: starts, ends and the first word of each row."""
    return spans(data, offsets, ~SPACE[data])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the first word of each row."""
    starts, ends, first = words(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the first of each row; 1 to k-1 words make one shingle of the whole row."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(begin[-1], np.uint64)
    for j in range(k):
        out += padded[at + j] * weights[j]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[begin[i]] = (hashes[first[i] : first[i + 1]] * weights[: counts[i]]).sum() + np.uint64(counts[i])
    return mix(out), begin
