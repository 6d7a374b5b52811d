"""Severity of toxic language by cumulative-link ordinal regression.

One weight vector serves every threshold: P(grade > j) = sigmoid(w.x - theta_j)
with theta_1 < theta_2 < theta_3, and the expected severity is the sum of these
probabilities (0 to 3). x holds the words and word beginnings that occur in a text, each
damped by its count, so a long text is judged by the words that are in it and
not by how much else there is.

Labels say toxic or not, and no graded labels exist. Grades are derived on the
training rows: a row that isn't toxic has grade 0; a toxic row has grade 1, 2 or
3 by how many of the words that set toxic rows apart it holds (tertiles of that
count). So the severity orders toxic texts by how much telling language they
hold; it is learned from the same words that it is predicted from and is no
evidence of how people would grade them. Whether a text is toxic at all rests on
the labels alone.

The model is fitted on at most ``sample`` labelled rows, the first by hash of the
id. Spark counts in how many of their rows each word occurs and keeps the
``MOST`` most telling; only the values of those reach the driver. numpy fits
weights and thresholds: first under a strong penalty that chooses the features,
then under one that falls as 1000 / rows (between a twentieth and the whole).
Scoring reads every whole text once and moves none.

Null and empty texts have no words and get the severity of a text without any
known word. Null or unlabelled rows are scored like others. Rows are judged one
by one, so ties and repeats don't matter. Without any labels of both kinds
nothing is toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import labelled, materialise, text_key

SAMPLE, MOST, LEAST_ROWS = 10_000, 1500, 3
#: Lengths of the word beginnings that count as features too; they stand for the many forms of one stem.
STEMS = (3, 5, 7)
WORD = re.compile(r"[^\W\d_]+")


def counted(text: str | None) -> dict[str, int]:
    """Counts of the words, lower-cased."""
    out: dict[str, int] = {}
    for w in WORD.findall((text or "").lower()):
        out[w] = out.get(w, 0) + 1
    return out


def with_stems(out: dict[str, int]) -> dict[str, int]:
    """Adds the counts of the words' beginnings."""
    for w, n in list(out.items()):
        for k in STEMS:
            if len(w) > k:
                stem = "^" + w[:k]
                out[stem] = out.get(stem, 0) + n
    return out


def words(text: str | None) -> dict[str, int]:
    return with_stems(counted(text))


@dataclass
class Ordinal:
    weights: dict[str, float]
    theta: tuple[float, ...]
    cut: float  # a text is called toxic from this probability on

    def score(self, found: dict[str, int]) -> tuple[float, float]:
        """(expected severity, probability of any toxicity)."""
        eta, get = 0.0, self.weights.get
        for w, n in found.items():
            if (x := get(w)) is not None:
                eta += x * (1 + np.log(n))
        p = [1 / (1 + np.exp(-np.clip(eta - t, -40, 40))) for t in self.theta]
        return float(sum(p)), float(p[0])


def telling(seen: DataFrame, n1: int, n0: int, most: int = MOST, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(w): features whose presence says most about y (chi-square with half a row added), ties by name; ``seen``: (w, y) of each row."""
    n = n1 + n0
    c = seen.groupBy("w").agg(F.count(F.lit(1)).alias("a"), F.sum("y").alias("a1")).filter(F.col("a") >= least_rows)
    p1, p0, p = F.col("a1") / n1, (F.col("a") - F.col("a1")) / n0, F.col("a") / n
    return c.select("w", ((p1 - p0) * (p1 - p0) / (p * (1 - p) + 0.5 / n)).alias("x2")).orderBy(F.desc("x2"), "w").limit(most).select("w")


@dataclass
class Sparse:
    """Feature values of the rows, only those that aren't 0."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    rows: int
    cols: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.rows)

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * d[self.row], self.cols)

    def only(self, cols: np.ndarray) -> Sparse:
        at = np.full(self.cols, -1)
        at[cols] = np.arange(len(cols))
        keep = at[self.col] >= 0
        return Sparse(self.row[keep], at[self.col[keep]], self.val[keep], self.rows, len(cols))


def likelihood(x: Sparse, grade: np.ndarray, w: np.ndarray, base: float, gap: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Mean log-likelihood of the grades and its slopes in the weights, the first threshold, and the logarithms of the gaps between thresholds."""
    n, rows = len(grade), np.arange(len(grade))
    theta = base + np.concatenate([[0], np.cumsum(np.exp(gap))])
    p = 1 / (1 + np.exp(-np.clip(x.times(w)[:, None] - theta, -40, 40)))
    # adjacent cumulative probabilities give the grade's own
    up = np.concatenate([np.ones((n, 1)), p], 1)[rows, grade]
    low = np.concatenate([p, np.zeros((n, 1))], 1)[rows, grade]
    mass = np.maximum(up - low, 1e-9)
    slope = p * (1 - p)
    pad = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], 1)
    d_eta = (pad[rows, grade] - pad[rows, grade + 1]) / mass / n
    d_theta = np.array([(np.where(grade == j, slope[:, j], 0) / mass).sum() - (np.where(grade == j + 1, slope[:, j], 0) / mass).sum() for j in range(3)]) / n
    d_gap = np.array([d_theta[1:].sum() * np.exp(gap[0]), d_theta[2] * np.exp(gap[1])])
    return float(np.log(mass).mean()), x.transposed_times(d_eta), float(d_theta.sum()), d_gap


def _descend(x: Sparse, grade: np.ndarray, l1: float, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal full-batch ascent of the ordinal likelihood; gaps are exponentials, so thresholds stay in order."""
    share = np.clip(np.stack([grade > j for j in range(3)], 1).mean(0), 1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    base, gap = theta[0], np.log(np.maximum(np.diff(theta), 0.05))
    w, gw, gb, gg = np.zeros(x.cols), np.full(x.cols, 1e-8), 1e-8, np.full(2, 1e-8)
    for _ in range(rounds):
        _, g, db, dg = likelihood(x, grade, w, base, gap)
        gw += g * g
        step = rate / np.sqrt(gw)
        w = w + step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        gb, gg = gb + db * db, gg + dg * dg
        base, gap = base + 0.1 * db / np.sqrt(gb), np.clip(gap + 0.1 * dg / np.sqrt(gg), -3, 3)
    return w, base + np.concatenate([[0], np.cumsum(np.exp(gap))])


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The probability that divides the rows with the fewest errors; the middle of the widest such gap."""
    order = np.argsort(logit, kind="stable")
    z, t = logit[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])  # with the first i rows below
    gaps = np.diff(np.concatenate([[z[0]], z, [z[-1]]]))
    gaps[errors > errors.min()] = -1
    i = int(gaps.argmax())
    middle = (z[max(i - 1, 0)] + z[min(i, len(z) - 1)]) / 2
    return float(1 / (1 + np.exp(-np.clip(middle, -6, 6))))


NOTHING = Ordinal({}, (40.0, 41.0, 42.0), 0.5)


def fit(x: Sparse, y: np.ndarray, vocab: list[str], l1: float = 4e-4, rounds: int = 150, refit: int = 500, rate: float = 0.5) -> Ordinal:
    """A first fit under a strong penalty chooses the features, a second under one that weakens as rows grow sets their weights."""
    if len(y) == 0 or y.min() == y.max():
        return NOTHING
    p1, p0 = (np.bincount(x.col[y[x.row] == k], minlength=x.cols) / (y == k).sum() for k in (1, 0))
    marks = np.bincount(x.row[(p1 > 3 * p0 + 0.002)[x.col]], minlength=x.rows)
    cut = np.quantile(marks[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (marks > cut[0]) + (marks > max(cut[1], cut[0] + 1)), 0).astype(int)
    w, _ = _descend(x, grade, l1, rounds, rate)
    chosen = np.flatnonzero(w)
    x = x.only(chosen)
    w, theta = _descend(x, grade, l1 * min(1.0, max(0.05, 1000 / len(y))), refit, rate)
    cut = best_cut(x.times(w) - theta[0], y)
    return Ordinal({vocab[j]: float(v) for j, v in zip(chosen, w) if v}, tuple(map(float, theta)), cut)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic", where=None) -> Ordinal:
    some = labelled(docs.sparkSession, labels.filter(F.col(label).isin(0, 1)), label, F.lit(True) if where is None else where, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")

    def counts(batches):
        for b in batches:
            c = [words(t.as_py()) for t in b.column(2)]
            off = pa.array(np.cumsum([0, *map(len, c)]).astype(np.int32))
            w, n = pa.array([w for x in c for w in x], pa.string()), pa.array([n for x in c for n in x.values()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(off, w), pa.ListArray.from_arrays(off, n)], ["doc_id", "y", "w", "n"])

    # one row an id: of texts under one id the first by its words
    one = rows.mapInArrow(counts, "doc_id long, y int, w array<string>, n array<int>").groupBy("doc_id", "y").agg(F.min(F.struct("w", "n")).alias("f"))
    one = materialise(one.select("doc_id", "y", "f.*"), "sample")
    got = sorted((r.doc_id, int(r.y)) for r in one.select("doc_id", "y").collect())  # at most ``sample`` rows
    y = np.array([k for _, k in got], int)
    if len(y) == 0 or y.min() == y.max():
        return NOTHING
    vocab = [r.w for r in telling(one.select("y", F.explode("w").alias("w")), int(y.sum()), int((1 - y).sum())).collect()]  # at most MOST
    col = {w: i for i, w in enumerate(vocab)}

    def chosen(batches):  # a row's values of the chosen features
        for b in batches:
            x = [[(col[w], n) for w, n in zip(ws, ns) if w in col] for ws, ns in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([[c[k] for c in r] for r in x], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "col", "n"])

    cells = one.select("doc_id", "w", "n").mapInArrow(chosen, "doc_id long, col array<int>, n array<int>")
    at, row, cols, val = {i: k for k, (i, _) in enumerate(got)}, [], [], []
    for r in sorted(cells.collect()):
        row += [at[r.doc_id]] * len(r.col)
        cols += r.col
        val += (1 + np.log(r.n)).tolist()
    return fit(Sparse(np.array(row, int), np.array(cols, int), np.array(val, float), len(y), len(vocab)), y, vocab)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, tkey, severity, p_toxic, toxic) of each row; toxic from the model's cut on."""

    def run(batches):
        for b in batches:
            s = [model.score(words(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in s], pa.float64()), pa.array([p for _, p in s], pa.float64()), pa.array([p >= model.cut for _, p in s], pa.bool_())], ["doc_id", "tkey", "severity", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text").mapInArrow(run, "doc_id long, tkey long, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, whole, in one pass over the texts and without a shuffle."""
    model = train(docs, labels, sample)

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.filter(pa.array([model.score(words(t.as_py()))[1] < model.cut for t in b.column(i)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
