"""Token counts by byte-pair merging with a heap over linked symbols; no identifiers are made.

A text's count is its number of initial symbols less the number of merges. The
initial symbols are its characters; one that is no piece stands for its UTF-8
bytes (byte fallback), of which none merges. The neighbours of a word are held
in two arrays of links, and a heap holds the adjacent pairs that make a piece,
the lowest rank first and the leftmost of equal ranks. Again and again the top
is popped; an entry whose symbols have changed since is passed over; a merge
links the right symbol out and pushes the two pairs that are new. That takes
n log n steps for a word of n symbols, so runs without blanks need no cut.

A word begins at a word-start mark, which no piece holds but at its start, or at
a symbol that no piece holds behind another (``pieces.cuts``), so nothing merges
across. Words repeat, so their counts are kept in a cache that is bounded by
bytes: two generations, of which the older is dropped when the younger is full.
Words of more than ``LONGEST`` characters aren't kept.

The model file (SentencePiece BPE, identity normaliser) is read on the driver
and broadcast; its size is that of a vocabulary. Rows are handled one by one
without a shuffle, so a lost task is run again by itself.

Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated
rows are counted each; an empty table gives an empty table. Other columns of the
input aren't looked at. Whole texts are counted, however long.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, Model, default_model

CACHE_BYTES, LONGEST, LIMIT = 128 << 20, 64, 4096


class Counts(dict):
    """Tokens of words. At half of ``CACHE_BYTES`` a generation ends; its words stay for one more."""

    def __init__(self, count) -> None:
        self.count, self.older, self.size = count, {}, 0

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.count(word)
        if len(word) <= LONGEST:
            if self.size > CACHE_BYTES // 2:
                self.older, self.size = dict(self), 0
                self.clear()
            self[word] = n
            self.size += 150 + 2 * len(word)  # an entry in a dict and a string; small numbers are shared
        return n


class Merger(Model):
    def __init__(self, model: bytes) -> None:
        super().__init__(model)
        number = {p: i for i, p in enumerate(self.scores)}
        if any(c not in number for p in number for c in p):
            raise ValueError("pieces of characters that are no pieces aren't supported")
        #: Symbols are the numbers of their pieces, and the first number behind for a character that is none.
        self.none = len(number)
        self.symbol = {p: i for p, i in number.items() if len(p) == 1}
        best = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = [best[s] for s in self.scores.values()]
        #: Left and right symbol, as one number, to the piece that they make.
        self.pairs = {number[p[:i]] * (self.none + 1) + number[p[i:]]: n for p, n in number.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.counts = Counts(self.word)

    def merges(self, part: list[int]) -> int:
        """How often two neighbours merge. An entry of the heap holds a piece's rank and the place of its left symbol."""
        made, rank, wide, n = self.pairs.get, self.rank, self.none + 1, len(part)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [rank[p] << bits | i for i, (a, b) in enumerate(zip(part, part[1:])) if (p := made(a * wide + b)) is not None]
        if not heap:
            return 0
        heapify(heap)
        part.append(self.none)  # the end, which is in no pair
        after, before = list(range(1, n + 2)), list(range(-1, n))
        merges = 0
        while heap:
            e = heappop(heap)
            i = e & mask
            if part[i] < 0:
                continue
            j = after[i]
            p = made(part[i] * wide + part[j])
            if p is None or rank[p] != e >> bits:
                continue
            merges += 1
            part[i], part[j] = p, -1
            k = after[i] = after[j]
            before[k] = i
            q = made(p * wide + part[k])
            if q is not None:
                heappush(heap, rank[q] << bits | i)
            h = before[i]
            if h >= 0:
                q = made(part[h] * wide + p)
                if q is not None:
                    heappush(heap, rank[q] << bits | h)
        return merges

    def word(self, word: str) -> int:
        """Tokens of a word: what its initial symbols count, less the merges in each part that no piece goes beyond."""
        parts = self.cut.findall(word)
        if len(parts) > 1:
            return sum(map(self.counts.__getitem__, parts))
        part = [self.symbol.get(c, self.none) for c in word]
        spelt = sum(len(c.encode("utf-8", "replace")) - 1 for c, r in zip(word, part) if r == self.none) if self.bytes_ and self.none in part else 0
        return len(word) + spelt - self.merges(part)

    def tokens(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.words.findall(self.normalised(text)))) if text else 0


_loaded: dict[int, Merger] = {}


def load(model: bytes) -> Merger:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Merger(model)
    return _loaded[key]


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(model_path or default_model()).read_bytes())

    def run(batches):
        t = load(sent.value)
        for b in batches:
            n = np.fromiter((t.tokens(x.as_py()) for x in b.column(2)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
