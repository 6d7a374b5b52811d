"""Metrics that need an assignment: Arrow-batched functions over whole columns.

Edit distances inside one row are computed once and shared by all that needs them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: str, b: str) -> int:
    """Edit distance, bit-parallel: one machine word operation a character for words of any length."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, d = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & full
        pv, mv = (mh << 1 & full) | ~(xv | ph) & full, ph & xv
    return d


def ned(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return distance(a, b) / n if n else 0.0


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment of a rectangular matrix (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for i in range(n):
        short, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        seen, r, low, j = [], i, 0.0, -1
        while True:
            seen.append(r)
            path = low + c[r] - u[r] - v
            better = ~done & (path < short)
            short[better], back[better] = path[better], r
            j = int(np.where(done, np.inf, short).argmin())
            low, done[j] = short[j], True
            if row_of[j] < 0:
                break
            r = row_of[j]
        u[i] += low
        for r in seen[1:]:
            u[r] += low - short[col_of[r]]
        v[done] += short[done] - low
        while True:
            r = back[j]
            row_of[j] = r
            col_of[r], j = j, col_of[r]
            if r == i:
                break
    rows, cols = np.arange(n), col_of
    if flip:
        rows, cols = cols, rows
        order = rows.argsort()
        rows, cols = rows[order], cols[order]
    return rows, cols


def costs(pred: list[str], gt: list[str]) -> np.ndarray:
    memo: dict[tuple[str, str], float] = {}
    return np.array([[memo[p, g] if (p, g) in memo else memo.setdefault((p, g), ned(p, g)) for g in gt] for p in pred]).reshape(len(pred), len(gt))


def gned_of(gt: list[str], pred: list[str]) -> float:
    """Least matched distance plus 1 for each token without a partner, over the longer list; 0 for two empty lists."""
    pred = [x for p in pred for x in p.split(" ")]
    n = max(len(gt), len(pred))
    if not n:
        return 0.0
    if not gt or not pred:
        return 1.0
    c = costs(pred, gt)
    return float((c[assign(c)].sum() + abs(len(pred) - len(gt))) / n)


def _gned(gt: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([None if g is None or p is None else gned_of(list(g), list(p)) for g, p in zip(gt, pred)], dtype="float64")


def typos_of(irrelevant: list[str], missing: list[str], most: float = 0.5) -> tuple[list[str], list[str], list[str]]:
    """(typos, irrelevant left, missing left)."""
    if not irrelevant or not missing:
        return [], irrelevant, missing
    c = costs(irrelevant, missing)
    pairs = [(i, j) for i, j in zip(*assign(c)) if c[i, j] < most]
    gone_i, gone_j = {i for i, _ in pairs}, {j for _, j in pairs}
    return [irrelevant[i] for i, _ in pairs], [x for i, x in enumerate(irrelevant) if i not in gone_i], [x for j, x in enumerate(missing) if j not in gone_j]


def _typo_pairs(irrelevant: pd.Series, missing: pd.Series) -> pd.DataFrame:
    rows = [typos_of(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(irrelevant, missing)]
    return pd.DataFrame({k: [r[i] for r in rows] for i, k in enumerate(("typo", "irrelevant", "missing"))})


# Made when used: a return type is parsed by a session, which executors that import this module don't have.


def gned(gt, pred) -> Column:
    """``gned_of`` of two token lists, null where one is null."""
    return F.pandas_udf(_gned, "double")(gt, pred)


def typo_pairs(irrelevant, missing) -> Column:
    """struct(typo, irrelevant, missing): pairs of the least-cost assignment that are near enough."""
    return F.pandas_udf(_typo_pairs, "struct<typo:array<string>,irrelevant:array<string>,missing:array<string>>")(irrelevant, missing)
