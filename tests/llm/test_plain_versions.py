"""Registered queries of learned models against plain versions of them, one text and one feature at a time."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lexigauge.llm import langid, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# -- languages


def symbol(ch):
    if not ch.isalpha():
        return 0
    k = ord(ch.lower()[0])
    return k - 96 if 97 <= k <= 122 else k - 196 if 0xDF <= k <= 0xFF else 60 + (k * 2654435761 >> 7) % 67


def bundle(text, letters, known):
    """The sum of the n-grams' vectors, each bound by a loop."""
    s = [0]
    for ch in text or "":
        c = symbol(ch)
        if c or s[-1]:
            s.append(c)
    if s[-1]:
        s.append(0)
    if len(s) == 1:
        return None
    total = np.zeros(letters.shape[1])
    for g, n in Counter(zip(s, s[1:], s[2:])).items():
        if g not in known:
            known[g] = np.roll(letters[g[0]], 2) * np.roll(letters[g[1]], 1) * letters[g[2]]
        total += n * known[g]
    return total


def test_languages(spark):
    letters, known, protos, texts = langid._letters(11, langid.DIM).astype(float), {}, defaultdict(float), {}
    for i, text, lang in rows(spark, "documents", "doc_id", "text", "lang"):
        h = texts[i] = bundle(text, letters, known)
        if h is not None and lang is not None and fold(i, 4) != 2:
            protos[lang] = protos[lang] + h / np.linalg.norm(h)
    names = sorted(protos)
    p = np.stack([protos[x] / np.linalg.norm(protos[x]) for x in names])
    got = queries.op2_langid(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        h = texts[r.doc_id]
        assert r.held_out == (fold(r.doc_id, 4) == 2)
        if h is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = p @ h / np.linalg.norm(h)
        assert cos[names.index(r.lang_pred)] == pytest.approx(cos.max(), abs=1e-4)
        assert r.score == pytest.approx(min(1, max(0, cos.max())), abs=1e-4)


# -- quality

M64 = (1 << 64) - 1
MIX = 0x9E3779B97F4A7C15


def buckets(text):
    """Counts of the hashed words, pairs and character n-grams."""
    out = Counter()
    shift = 64 - quality.BITS
    w = [xxhash.xxh3_64_intdigest(x.encode()) for x in (text or "").split()]
    for a in w:
        out[(a * MIX & M64) >> shift] += 1
    for a, b in zip(w, w[1:]):
        out[(((a ^ b) + 77 & M64) * MIX & M64) >> shift] += 1
    c = [ord(ch) for ch in f" {text} "] if text else []
    for n in quality.GRAMS:
        for j in range(len(c) - n + 1):
            h = n
            for ch in c[j : j + n]:
                h = (h + ch & M64) * 0xBF58476D1CE4E5B9 & M64
                h ^= h >> 29
            out[(h * MIX & M64) >> shift] += 1
    return out


def test_features_of_quality(spark):
    texts = [t for _, t in rows(spark, "documents", "doc_id", "text") if len(t or "") < 4000][:60] + ["", None, "a", "鱼 é 😀", "same same same"]
    for t in texts:
        assert Counter(quality.features(t).tolist()) == buckets(t)


def test_quality(spark):
    """Gradient descent with a loop over features, in double precision; the query's in single, so scores agree nearly."""
    texts = dict(rows(spark, "documents", "doc_id", "text"))
    kinds = defaultdict(set)
    for i, q in rows(spark, "labels", "doc_id", "quality"):
        if i in texts and q in (0, 1) and fold(i, 3) != 1:
            kinds[i].add(q)
    ids = sorted(i for i, q in kinds.items() if len(q) == 1)
    y = np.array([min(kinds[i]) for i in ids])
    share = {i: {b: n / sum(c.values()) for b, n in c.items()} for i, c in ((i, buckets(t)) for i, t in texts.items()) if c}
    r = np.random.default_rng(5)
    e = r.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM))
    w, b = np.zeros((quality.DIM, 2)), np.zeros(2)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.sqrt(weight / weight.mean())
    step, total = 0, 6 * len(y)
    for _ in range(6):
        for k in r.permutation(len(y)):
            x, rate = share.get(ids[k], {}), 4.0 * (1 - step / total)
            step += 1
            h = sum((s * e[f] for f, s in x.items()), np.zeros(quality.DIM))
            p = np.exp(h @ w + b)
            p = weight[k] * (p / p.sum() - np.eye(2)[y[k]])
            back = w @ p
            w = w - rate * 0.25 * np.outer(h, p)
            b = b - rate * 0.02 * p
            for f, s in x.items():
                e[f] -= rate * 8 * s * back
    got = queries.op5_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for g in got:
        z = sum((s * e[f] for f, s in share.get(g.doc_id, {}).items()), np.zeros(quality.DIM)) @ w + b
        assert g.score == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=5e-3)
        assert g.predicted == (g.score >= 0.5) and g.held_out == (fold(g.doc_id, 3) == 1)
