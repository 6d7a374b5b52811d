"""Sequence-matcher ratio of strings: twice the matched characters over both lengths.

The longest block that both strings share (the leftmost of equally long ones in
the first string, then in the second) is matched, and then what lies left and
right of it, again and again. In strings of at least ``MANY`` characters, those
that make up more than one in a hundred don't begin a block; they extend one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MANY = 200


class Against:
    """A string that others are compared with, with the places of its characters."""

    def __init__(self, b: str) -> None:
        self.b, self.count = b, Counter(b)
        #: How long a common block may be is found from the places where a character begins or goes on.
        self.places: dict[str, list[int]] = {}
        for j, c in enumerate(b):
            self.places.setdefault(c, []).append(j)
        if len(b) >= MANY:
            most = len(b) // 100 + 1
            self.places = {c: js for c, js in self.places.items() if len(js) <= most}

    def block(self, a: str, lo: int, hi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(place in a, place in b, length) of the longest block in a[lo:hi] and b[blo:bhi]."""
        b, best_i, best_j, best = self.b, lo, blo, 0
        ends: dict[int, int] = {}  # lengths of the blocks that end at the character before, by their end in b
        for i in range(lo, hi):
            now: dict[int, int] = {}
            for j in self.places.get(a[i], ()):
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = now[j] = ends.get(j - 1, 0) + 1
                if k > best:
                    best_i, best_j, best = i - k + 1, j - k + 1, k
            ends = now
        while best_i > lo and best_j > blo and a[best_i - 1] == b[best_j - 1]:
            best_i, best_j, best = best_i - 1, best_j - 1, best + 1
        while best_i + best < hi and best_j + best < bhi and a[best_i + best] == b[best_j + best]:
            best += 1
        return best_i, best_j, best

    def matched(self, a: str) -> int:
        """Characters in matching blocks."""
        total, todo = 0, [(0, len(a), 0, len(self.b))]
        while todo:
            lo, hi, blo, bhi = todo.pop()
            i, j, n = self.block(a, lo, hi, blo, bhi)
            if n:
                total += n
                if lo < i and blo < j:
                    todo.append((lo, i, blo, j))
                if i + n < hi and j + n < bhi:
                    todo.append((i + n, hi, j + n, bhi))
        return total

    def ratio(self, a: str) -> float:
        n = len(a) + len(self.b)
        return 2.0 * self.matched(a) / n if n else 1.0

    def at_most(self, a: str) -> float:
        """What the ratio can't exceed: the characters that both have, as multisets."""
        n = len(a) + len(self.b)
        return 2.0 * sum((self.count & Counter(a)).values()) / n if n else 1.0

    def nearest(self, others: list[str]) -> str | None:
        """The one with the largest ratio, the last in order of equals. Only those whose length and characters allow as much are matched."""
        n, best, found = len(self.b), -1.0, None
        length = lambda x: 2.0 * min(n, len(x)) / (n + len(x)) if n + len(x) else 1.0
        for x in sorted(set(others), key=lambda x: (-length(x), x)):
            if length(x) < best:
                break
            if self.at_most(x) >= best and ((r := self.ratio(x)) > best or r == best and x > found):
                best, found = r, x
        return found


def ratio_of(a: str, b: str) -> float:
    return Against(b).ratio(a)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, Against] = {}
    out = np.full(len(a), np.nan)
    for i, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None:
            if y not in known:
                known = {y: Against(y)}  # rows of one word follow each other
            out[i] = known[y].ratio(x)
    return pd.Series(out)


def _nearest(word: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([None if w is None or o is None else Against(w).nearest([x for x in o if x is not None]) for w, o in zip(word, others)], dtype="object")


# Made when used: a return type is parsed by a session, which executors that import this module don't have.


def ratio(a, b) -> Column:
    """Ratio of ``a`` against ``b``, null where one is null."""
    return F.nanvl(F.pandas_udf(_ratios, "double")(a, b), F.lit(None))


def closest(word, others) -> Column:
    """The string of a list (as of one row's recognised words) with the largest ratio, null without any."""
    return F.pandas_udf(_nearest, "string")(word, others)
