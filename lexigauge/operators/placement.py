"""Placement of text regions near given points, so that they don't overlap: the exact optimum for a list of shapes.

The sum of Manhattan distances between regions' centres and their points is
minimised. Each region has the least area and one of ``ratios`` of width to
height. Branch and bound over what stands left of or above what: a node knows
some of these orders and some shapes; its bound is the optimum under them alone,
which two problems on a line give, one for each axis. Where two regions overlap
in it, the node branches into their four orders, and where a shape is open, into
the shapes; a node whose optimum breaks nothing is the best of all, since nodes
are taken by their bounds.

Layouts are independent rows, so Spark deals them to tasks; a layout has a
handful of regions, as a prompt has texts.
"""

from __future__ import annotations

import heapq
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIOS, SLACK = (1.5, 2.0, 2.5), 1e-9


def on_a_line(points: list[float], half: list[float], gaps: list[tuple[int, int]]) -> tuple[float, list[float]] | None:
    """(cost, centres) of intervals inside [0, 1] nearest to their points, with i left of j for each (i, j); None if there is no room.

    Centres begin at their leftmost places, and as long as it pays, a set of
    intervals that push nothing else moves right together to the next point,
    border or interval. Costs are convex along such sets, so the end is optimal.
    """
    n = len(points)
    x = list(half)
    for _ in range(n):
        for i, j in gaps:
            x[j] = max(x[j], x[i] + half[i] + half[j])
    if any(x[i] > 1 - half[i] + SLACK for i in range(n)):
        return None
    room = lambda i, j: x[j] - x[i] - half[i] - half[j]
    while True:
        best, chosen = 0, ()
        for size in range(1, n + 1):
            for s in combinations(range(n), size):
                gain = sum(1 if x[i] < points[i] - SLACK else -1 for i in s)
                if gain > best and all(x[i] < 1 - half[i] - SLACK for i in s) and all(i not in s or j in s or room(i, j) > SLACK for i, j in gaps):
                    best, chosen = gain, s
        if not chosen:
            return sum(abs(a - p) for a, p in zip(x, points)), x
        step = min(1 - half[i] - x[i] for i in chosen)
        step = min([step, *(points[i] - x[i] for i in chosen if x[i] < points[i] - SLACK), *(room(i, j) for i, j in gaps if i in chosen and j not in chosen)])
        for i in chosen:
            x[i] += step


def place(points: list[tuple[float, float]], area: float, ratios: tuple[float, ...] = RATIOS) -> tuple[float, list[tuple[float, float, float, float]]] | None:
    """(cost, regions as left, top, width, height), or None if they can't be placed."""
    n = len(points)
    shapes = [((area * r) ** 0.5, (area / r) ** 0.5) for r in ratios]
    open_ = (min(w for w, _ in shapes), min(h for _, h in shapes))
    heap, count = [], 0

    def add(beside: tuple, over: tuple, shape: tuple) -> None:
        nonlocal count
        size = [open_ if k is None else shapes[k] for k in shape]
        found = [on_a_line([p[axis] for p in points], [s[axis] / 2 for s in size], order) for axis, order in ((0, beside), (1, over))]
        if all(found):
            count += 1
            heapq.heappush(heap, (found[0][0] + found[1][0], count, beside, over, shape, size, found[0][1], found[1][1]))

    add((), (), (None,) * n)
    while heap:
        cost, _, beside, over, shape, size, x, y = heapq.heappop(heap)
        hit = next(((i, j) for i, j in combinations(range(n), 2) if abs(x[i] - x[j]) < (size[i][0] + size[j][0]) / 2 - SLACK and abs(y[i] - y[j]) < (size[i][1] + size[j][1]) / 2 - SLACK), None)
        if hit:
            for pair in (hit, hit[::-1]):
                add((*beside, pair), over, shape)
                add(beside, (*over, pair), shape)
        elif None in shape:
            at = shape.index(None)
            for k in range(len(shapes)):
                add(beside, over, (*shape[:at], k, *shape[at + 1 :]))
        else:
            return cost, [(a - w / 2, b - h / 2, w, h) for a, b, (w, h) in zip(x, y, size)]
    return None


def placed(points: DataFrame, layout: str, pos: str, x: str, y: str, area: float, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(layout, pos, m_offset, n_offset, m_scale, n_scale, cost): a region for each point, nulls where a layout has no room; cost is the layout's."""
    lists = points.groupBy(layout).agg(F.array_sort(F.collect_list(F.struct(pos, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))

    def run(frames):
        for f in frames:
            out = []
            for name, p in zip(f[layout], f["p"]):
                found = place([(q["x"], q["y"]) for q in p], area, ratios)
                cost, regions = found or (None, [(None,) * 4] * len(p))
                out += [(name, q[pos], *r, cost) for q, r in zip(p, regions)]
            yield pd.DataFrame(out, columns=[layout, pos, "m_offset", "n_offset", "m_scale", "n_scale", "cost"])

    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    return lists.mapInPandas(run, f"`{layout}` {kind[layout]}, `{pos}` {kind[pos]}, m_offset double, n_offset double, m_scale double, n_scale double, cost double")
