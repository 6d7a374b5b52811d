"""Text quality by supervised subword embeddings.

Words, neighbouring word pairs and character n-grams are hashed into buckets,
each with a learned vector; a document is the average of its features' vectors,
and a softmax layer over the average gives the score. Vectors and layer are
trained together by stochastic gradient descent in numpy on at most ``sample``
labelled rows, the first by hash of the id; a row's buckets and shares reach the
driver, 6 bytes for each of at most 32768 different buckets, whatever the text's
length. Labels other than 0 and 1 teach nothing. A pair's hash is that of the
exclusive-or of its words' hashes, so every immediate repetition has one bucket.

Every whole text is scored, in one pass and without a shuffle. Null and empty
texts have no features and get the layer's bias. Without labels of both kinds
every score is 0.5. Rows are judged one by one; ties and repeats don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_mod, labelled

SAMPLE, BITS, DIM = 6_000, 15, 12
GRAMS = (3, 4)
WORDS_CACHED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_cache: dict[str, int] = {}


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Bucket of each feature of the text, repeats included."""
    if not text:
        return np.empty(0, np.int64)
    shift = np.uint64(64 - bits)
    if len(_cache) > WORDS_CACHED:
        _cache.clear()
    get, put = _cache.get, xxhash.xxh3_64_intdigest
    w = np.array([get(x) or _cache.setdefault(x, put(x.encode("utf-8", "surrogatepass"))) for x in text.split()], np.uint64)
    out = [(w * _MIX) >> shift]
    if len(w) > 1:
        out.append((((w[1:] ^ w[:-1]) + np.uint64(77)) * _MIX) >> shift)
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + c[i : len(c) - n + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out.append((h * _MIX) >> shift)
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    layer: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """Each bucket's share in the logit difference; averaging these equals averaging vectors first."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


def fit(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 6, rate: float = 4.0, seed: int = 5) -> Model:
    """``found``: bucket ids and counts, or shares, of each row; y: 0 or 1."""
    r = np.random.default_rng(seed)
    e = r.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(e, w, b)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.sqrt(weight / weight.mean())
    steps, total = 0, epochs * len(y)
    for _ in range(epochs):
        for i in r.permutation(len(y)):
            idx, share = found[i][0], found[i][1].astype(np.float32)
            share /= max(1e-9, share.sum())
            lr = rate * (1 - steps / total)
            steps += 1
            h = share @ e[idx] if len(idx) else np.zeros(dim, np.float32)
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[i]
            back = w @ p
            w -= lr * 0.25 * np.outer(h, p)
            b -= lr * 0.02 * p
            if len(idx):
                e[idx] -= np.float32(lr * 8) * share[:, None] * back
    return Model(e, w, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", where=None) -> Model:
    some = labelled(docs.sparkSession, labels.filter(F.col(label).isin(0, 1)), label, F.lit(True) if where is None else where, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")

    def brief(batches):  # buckets and their shares, 6 bytes together
        for b in batches:
            packed = []
            for t in b.column(2):
                i, n = np.unique(features(t.as_py()), return_counts=True)
                packed.append(i.astype(np.uint16).tobytes() + (n / n.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "y", "f"])

    one = rows.mapInArrow(brief, "doc_id long, y int, f binary").groupBy("doc_id", "y").agg(F.min("f").alias("f"))
    got = [(r.doc_id, int(r.y), bytes(r.f)) for r in one.collect()]  # at most ``sample`` rows, one an id
    found = [(np.frombuffer(f, np.uint16, k := len(f) // 6), np.frombuffer(f, np.float32, k, 2 * k)) for *_, f in sorted(got)]
    return fit(found, np.array([y for _, y, _ in sorted(got)], int))


def quality(docs: DataFrame, model: Model, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    margins, bias = model.margins(), float(model.bias[1] - model.bias[0])

    def run(batches):
        for b in batches:
            s = []
            for t in b.column(2):
                i = features(t.as_py())
                s.append(1 / (1 + np.exp(-np.clip((margins[i].mean() if len(i) else 0.0) + bias, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
