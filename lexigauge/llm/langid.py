"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product of
its letters' vectors, each rotated by its place (binding permuted vectors); a
text is the sum of its n-grams' vectors (bundling); a language's prototype is
the sum over its training texts, each text scaled to the same weight. A text
gets the language whose prototype has the largest cosine with it.

A letter becomes one of 127 symbols: ASCII and Latin-1 letters each have their
own, others are dealt by their code point. All that isn't a letter is a single
word break. Texts are handled some hundred at a time: their n-gram counts,
multiplied by the vectors of the n-grams that occur, give all their bundles in
one product. Prototypes are summed by Spark over all training rows, with partial
sums in every task; one row per language and component is what reaches the
driver. No text moves.

Null texts and texts without a letter are ``und`` with score 0. Null languages
and rows with a null id teach nothing. Without training rows all is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_mod

DIM, N, BITS = 512, 3, 7
CHARS_AT_ONCE = 400_000
_table: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """Symbol of each code point; 0 for all that isn't a letter."""
    global _table
    if _table is None:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                k = ord(chr(c).lower()[0])
                t[c] = k - 96 if 97 <= k <= 122 else k - 196 if 0xDF <= k <= 0xFF else 60 + (k * 2654435761 >> 7) % 67
        _table = t
    return _table


def _letters(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (1 << BITS, dim))


def grams(text: str | None) -> np.ndarray:
    """Letter n-grams of a text as numbers; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    c = _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not c.any():
        return np.empty(0, np.int64)
    c = np.concatenate([[0], c, [0]]).astype(np.int64)
    c = c[(c > 0) | (np.concatenate([[1], c[:-1]]) > 0)]
    if len(c) < N:
        c = np.concatenate([c, np.zeros(N - len(c), np.int64)])
    g = np.zeros(len(c) - N + 1, np.int64)
    for i in range(N):
        g = (g << BITS) | c[i : len(c) - N + 1 + i]
    return g


def bundles(found: list[np.ndarray], letters: np.ndarray) -> np.ndarray:
    """One bundle (row) for each list of n-grams."""
    sizes = np.array([len(g) for g in found])
    if not sizes.sum():
        return np.zeros((len(found), letters.shape[1]), np.float32)
    every = np.concatenate(found)
    present = np.flatnonzero(np.bincount(every, minlength=1 << (BITS * N)))
    place = np.zeros(1 << (BITS * N), np.int32)
    place[present] = np.arange(len(present))
    counts = np.bincount(np.repeat(np.arange(len(found)), sizes) * len(present) + place[every], minlength=len(found) * len(present))
    v = np.ones((len(present), letters.shape[1]), np.int8)
    for i in range(N):
        v *= np.roll(letters, N - 1 - i, 1)[(present >> (BITS * (N - 1 - i))) & ((1 << BITS) - 1)]
    return counts.reshape(len(found), -1).astype(np.float32) @ v.astype(np.float32)


def _parts(rows, most_rows: int = 192):
    """Splits rows (.., text) so that each part has a bounded number of rows and characters."""
    part, chars = [], 0
    for r in rows:
        if part and (len(part) >= most_rows or chars + len(r[-1] or "") > CHARS_AT_ONCE):
            yield part
            part, chars = [], 0
        part.append(r)
        chars += len(r[-1] or "")
    if part:
        yield part


def prototypes(train: DataFrame, dim: int = DIM, seed: int = 11) -> dict[str, np.ndarray]:
    """Unit prototype of each language; ``train``: (lang, text) without null languages."""

    def run(batches):
        letters, total = _letters(seed, dim), {}
        for b in batches:
            for part in _parts(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = bundles([grams(t) for _, t in part], letters)
                h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)
                for lang in {x for x, _ in part}:
                    total[lang] = total.get(lang, 0) + h[[x == lang for x, _ in part]].sum(0, dtype=np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    sums = train.select("lang", "text").mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dim rows
        out.setdefault(r.lang, np.zeros(dim))[r.pos] = r.v
    return {k: v / n for k, v in out.items() if (n := np.linalg.norm(v))}


def identify(docs: DataFrame, protos: dict[str, np.ndarray], folds: int = 4, held: int = 2, dim: int = DIM, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    names = sorted(protos)

    def run(batches):
        letters = _letters(seed, dim)
        p = np.stack([protos[x] for x in names]).astype(np.float32) if names else None
        for b in batches:
            lang, score = [], []
            for part in _parts([(t,) for t in b.column(2).to_pylist()]):
                found = [grams(t) for (t,) in part]
                if p is None:
                    lang += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                h = bundles(found, letters)
                cos = (h @ p.T) / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(1)
                lang += [names[k] if len(g) else "und" for g, k in zip(found, best)]
                score += [float(min(1.0, max(0.0, c[k]))) if len(g) else 0.0 for g, k, c in zip(found, best, cos)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, folds: int = 4, held: int = 2, dim: int = DIM) -> DataFrame:
    """Learns from rows outside the held-out fold, then predicts every row."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    return identify(docs, prototypes(known, dim), folds, held, dim)
