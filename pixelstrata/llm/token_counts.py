"""Exact BPE token counts of every prefix by dynamic programming over prefixes.

For a byte-level BPE vocabulary, the last token of a prefix's encoding is the one token that ends there and whose
predecessor, the last token of what stands before it, stays apart from it under the merges. So one pass over a piece
gives count[j] = count[j - len(token)] + 1 for every prefix j. A text is cut at spaces that follow a
non-space character: neither side's tokens depend on the other there, in the whole text or in any prefix of it.
With the running total at each cut, and the table of each distinct piece, the count of any prefix is one addition,
so truncation points and budgets need no encoding.

`token_counts` returns the totals; `prefix_tokens` the table of every character prefix; `fit_to_budget` the longest
prefix within a budget. Counts are those of the library for the vocabulary file, without added special tokens;
special strings inside a text are one token each. Null texts count as empty (0 bytes, 0 tokens); repeated rows and
null doc_ids return their rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import blocks

CACHED = 1_000_000  # distinct pieces a worker keeps; more start afresh
SAFE_CUT = re.compile(r"(?<=\S) ")
UNSAFE = re.compile(r"\s ")
ENDS = frozenset(".,;:!?")


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others count from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes for one byte-level BPE vocabulary file (of the tokenizers library)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.splitter = self.library.pre_tokenizer
        of = byte_characters()
        to_bytes = lambda s: bytes(of[c] for c in s)
        self.rank = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[to_bytes(left), to_bytes(right)] = i
        self.halves, self.made = {}, {bytes([b]): -1 for b in range(256)}
        for (left, right), i in self.rank.items():
            if left + right not in self.made and left in self.made and right in self.made:
                self.made[left + right], self.halves[left + right] = i, (left, right)
        self.texts = sorted(self.made)
        self.ids = {t: i for i, t in enumerate(self.texts)}
        self.longest = max(map(len, self.texts))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_texts = special
        self.apart: dict[int, bool] = {}  # by the two tokens' places in texts
        self.marks = {c: self.count(c) for c in ENDS}
        self.piece_count = _Counts(self)

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave left and right as two tokens: their merges are undone, latest first, and no pair
        that meets at the boundary may merge before the ones around it did. Merges of one rank go from the left."""
        if (left, right) in self.rank:
            return False
        made, halves, rank = self.made, self.halves, self.rank
        while True:
            one, two = made[left], made[right]
            if one < 0 and two < 0:
                return True
            if one > two:
                limit, left = one, halves[left][1]
            else:
                limit, right = two + 1, halves[right][0]
            if rank.get((left, right), limit) < limit:
                return False

    def _meets(self, key: int) -> bool:
        if len(self.apart) > CACHED:
            self.apart.clear()
        found = self.apart[key] = self._apart(self.texts[key >> 20], self.texts[key & 0xFFFFF])
        return found

    def byte_prefixes(self, word: bytes) -> list[int]:
        """count[j]: the tokens of word[:j], for a word that no pre-token boundary cuts."""
        size = len(word)
        count, last = [0] * (size + 1), [0] * (size + 1)
        ids, apart, longest = self.ids.get, self.apart.get, self.longest
        for j in range(1, size + 1):
            for i in range(j - longest if j > longest else 0, j):
                t = ids(word[i:j])
                if t is not None:
                    if i:
                        key = last[i] | t
                        ok = apart(key)
                        if not (self._meets(key) if ok is None else ok):
                            continue
                    count[j], last[j] = count[i] + 1, t << 20
                    break
        return count

    def split(self, piece: str) -> list[str]:
        """The pre-tokens of a piece, as the library cuts them."""
        if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
            if max(piece) < "ɐ":
                return [piece]
        return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]

    def count(self, piece: str) -> int:
        return sum(self.byte_prefixes(w.encode())[-1] for w in self.split(piece))

    def segments(self, text: str) -> list[tuple[str, int]]:
        """Texts between special strings, and for each the count of special tokens after it."""
        if not self.special or not any(s in text for s in self.special_texts):
            return [(text, 0)]
        cuts = [m.span() for m in self.special.finditer(text)]
        begins, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]
        return [(text[a:b], int(i < len(cuts))) for i, (a, b) in enumerate(zip(begins, ends, strict=True))]

    def pieces(self, text: str) -> list[str]:
        return SAFE_CUT.split(text) if UNSAFE.search(text) else text.split(" ")

    def total(self, text: str) -> int:
        """The tokens of the text: its last prefix's count."""
        n = 0
        for segment, after in self.segments(text):
            first, *rest = self.pieces(segment)
            n += after + (self.count(first) if first else 0) + sum(map(self.piece_count.__getitem__, rest))
        return n

    def character_prefixes(self, piece: str) -> list[int]:
        """Counts of piece[:j] for each j, as if the piece were a whole text."""
        words, out, done, at = self.split(piece), [0], 0, 0
        for i, word in enumerate(words):
            if i and words[i - 1].isspace() and word[:1].isspace():  # the run of white space grows while the prefix ends in it
                again, base = words[i - 1], done - self.count(words[i - 1])
            else:
                again, base = "", done
            plain = self.byte_prefixes(word.encode()) if not again and self.split(word) == [word] and (word.strip().isalpha() or word.isspace()) else None
            width = 0
            for j in range(1, len(word) + 1):
                width += len(word[j - 1].encode())
                out.append(base + plain[width] if plain else base + self.count(again + word[:j]) if j < len(word) or again else done + self.count(word))
            if i + 1 < len(words) or again:
                done += self.count(word)
                if again:
                    out[-1] = done if not word.isspace() else base + self.count(again + word)
            at += len(word)
        return out

    def prefixes(self, text: str) -> list[int]:
        """count[j]: the tokens of text[:j] for every j from 0 to len(text). A special string counts once it is whole;
        its prefixes are ordinary text."""
        out, base = [0], 0
        at = 0
        for segment, after in self.segments(text):
            for k, piece in enumerate(self.pieces(segment)):
                piece = piece if k == 0 else " " + piece
                local = self.character_prefixes(piece) if piece else [0]
                out += [base + c for c in local[1:]]
                base += local[-1]
            at += len(segment)
            if after:
                mark = self.special.match(text, at).group()
                tail = self.pieces(segment)[-1]
                tail = tail if len(self.pieces(segment)) == 1 else " " + tail
                before = base - (self.character_prefixes(tail)[-1] if tail else 0)
                out += [before + self.character_prefixes(tail + mark[:j])[-1] for j in range(1, len(mark))]
                base += 1
                out.append(base)
                at += len(mark)
        return out


class _Counts(dict):
    """Counts of pieces that follow a space."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if piece[-1:] in ENDS and piece[:-1].isalpha():  # a word of letters and one mark never share a token
            n = self[piece[:-1]] + self.counter.marks[piece[-1]]
        else:
            n = self.counter.count(" " + piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; over_limit: the whole text has over `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch, _, offsets in blocks(batches):
            totals = [own.total(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(offsets[1:] - offsets[:-1]), pa.array(totals, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, counts): the exact token count of every character prefix, from the empty one to the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch, _, _ in blocks(batches, size=1 << 17):
            rows = [own.prefixes(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def fit_to_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_characters, n_tokens): the longest prefix of at most `budget` tokens, read off the table."""
    last = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i)))
    return prefixes.select("doc_id", last.alias("n_characters"), F.element_at("counts", last + 1).alias("n_tokens"))
