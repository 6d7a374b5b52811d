"""The prefix trie against plain dictionaries, whitening against an eigendecomposition, token counts against the library."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigauge.llm import pieces, prefix_trie, queries, token_counts, whitening

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
sp = pytest.importorskip("sentencepiece")

# -- prefix trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def nodes(sequences):
    """All nodes of {conv_id: [(role, text)]} by (smallest member, depth)."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(m) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k))))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(ends))
    return out


def rebuilt(rows):
    """Conversations of rows (conv_id, turn, role, text) without ties, rebuilt."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])[: h[c]] + own[c][h[c] :] for c in own}


def found(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


@needs_tables
def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, SF)) == nodes(rebuilt(rows))


@pytest.mark.parametrize("local", [0, 3, 40, 10_000])
def test_trie_of_any_shape(spark, local):
    """Copies, rows within rows, long shared prefixes, a row of many turns; buckets of all sizes."""
    rnd = random.Random(local)
    seqs = [[rnd.randint(1, 3) for _ in range(rnd.randint(0, 7))] for _ in range(60)]
    seqs += [[7] * n for n in range(12)] + [[5] * 30 + [x, 2] for x in (1, 2, 3)] + [[9, 9]] * 20 + [list(range(10, 400))]
    ids = rnd.sample(range(-500, 5000), len(seqs))
    length = {i: i % 5 for i in range(400)}
    df = spark.createDataFrame([(c, s, [length[i] for i in s]) for c, s in zip(ids, seqs)], "c long, ids array<long>, chars array<int>")
    want = nodes({c: [(i, "x" * length[i]) for i in s] for c, s in zip(ids, seqs)})
    assert found(prefix_trie.trie(df, local)) == want


def test_trie_many_copies_make_several_blocks(spark):
    df = spark.range(1, 2001).select((F.col("id") * 7 - 500).alias("c"), F.expr("array(4L)").alias("ids"), F.expr("array(3)").alias("chars"))
    ids = ",".join(str(i * 7 - 500) for i in range(1, 2001))
    got = found(prefix_trie.trie(df, 10))
    assert got == {(-493, 0): (None, 2000, 1, 1, 1999 * 3, sha("")), (-493, 1): (-493, 2000, 0, 1, 1999 * 3, sha(ids))}


def test_trie_odd(spark):
    rows = [
        (100, 0, "user", "hello"), (100, 1, None, None), (100, 2, "user", "x"), (100, None, "system", "first"), (101, 0, "user", "y"), (101, 1, "", ""), (None, 0, "user", "no id"), (None, None, None, None),
        (7, 0, "user", "L" * 300_000), (8, 0, "user", "鱼龙😀"), (-205, 0, "user", "z"), (-200, 0, "user", "w"), (-200, 1, "user", "v"), (0, 3, "a:b", "c"), (1, 3, "a", "b:c"), (3, 0, "", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("mine")).withColumn("depth", F.lit(3)).withColumn("key", F.lit(1))
    assert found(prefix_trie.prefix_trie(df)) == nodes(rebuilt(rows))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.filter("conv_id IS NULL")).count() == 0
    # a conversation whose turns are all replaced by those of a family that isn't there
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([(alone, 0, "user", "gone")], df.schema[:4]))) == {(alone, 0): (None, 1, 0, 1, 0, sha(str(alone)))}


def test_trie_ties_have_one_order(spark):
    """Turns of one number are ordered by their content, so the order of the rows says nothing; repeated rows are turns of their own."""
    rows = [(6 * i, 0, "user", t) for i in range(5) for t in ("b", "a", "b", "c")]
    schema = "conv_id long, turn long, role string, text string"
    a, b = (found(prefix_trie.prefix_trie(spark.createDataFrame(r, schema).repartition(n))) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert a == b and max(d for _, d in a) >= 4


@settings(max_examples=200, deadline=None)
@given(st.sets(st.lists(st.integers(0, 3), min_size=1, max_size=6).map(tuple), min_size=1, max_size=25))
def test_quicksort(rows):
    rows = sorted(rows, key=lambda r: hash((r, 1)))
    order, blocks = prefix_trie.quicksort(np.cumsum([0, *map(len, rows)]), np.array([i for r in rows for i in r], np.int64))
    assert [rows[i] for i in order] == sorted(rows)
    made = [rows[order[lo]][:d] for lo, _, top, last, _, _ in blocks for d in range(top, last + 1)]
    assert sorted(made) == sorted({r[:d] for r in rows for d in range(1, len(r) + 1)})


# -- whitening


def expected(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], q[:, ::-1]


def check_whitened(got, ids, x, k=4):
    n, s, e, q = expected(x)
    g = got.set_index(["vec_id", "component"]).sort_index()
    assert len(got) == len(ids) * k and set(got.n) == {n} and got.identity_error.max() <= 1e-9
    for j in range(k):
        h = g.xs(j + 1, level=1).loc[ids]
        z = (x - s / n) @ q[:, j] / np.sqrt(e[j])
        assert min(np.abs(h.whitened.values - z).max(), np.abs(h.whitened.values + z).max()) < 1e-6
        assert h.explained.iloc[0] == pytest.approx(e[j] / e.sum(), rel=1e-9)
        assert (h.deviation.values == ((n * x - s) ** 2).sum(axis=1)).all()


@needs_tables
def test_whitening_of_the_table(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    check_whitened(queries.op12_whitening(spark, SF).toPandas(), raw.vec_id, np.floor(np.stack(raw.embedding) * 256.0).astype(np.int64))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_whitening_in_any_number_of_parts(spark, parts):
    """More than one round of merges; a third of the rows are one vector, which counts once; a mean far from zero."""
    rnd = np.random.default_rng(parts)
    v = rnd.normal(size=(300, 6)) * np.array([9, 5, 3, 1, 0.5, 0.1]) + 1000
    v[::3] = v[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(parts)
    check_whitened(whitening.whiten(df).toPandas(), range(300), np.floor(v * 256).astype(np.int64))


def test_merging_loses_nothing():
    x = np.random.default_rng(5).integers(-900, 900, (500, 7))
    one, parts = whitening.summarise(x), [whitening.summarise(p) for p in np.array_split(x, 30)]
    while len(parts) > 1:
        parts = [whitening.merge(a, b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    assert parts[0][0] == 500 and list(parts[0][1]) == list(one[1]) == x.sum(axis=0).tolist()
    assert np.allclose(parts[0][3].T @ parts[0][3], one[3].T @ one[3], rtol=1e-12)


def test_whitening_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [3.5, -2.0]), (2, [3.5, -2.0]), (None, [0.0, -0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [1.0]), (9, []), (10, [-0.001, 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("mine")).withColumn("x", F.lit(1)).withColumn("node", F.lit(2))
    got = whitening.whiten(df).toPandas()
    assert sorted(got.vec_id.fillna(-1).astype(int)) == sorted([1, 2, 2, -1, 10] * 2) and set(got.n) == {4}
    assert got.identity_error.max() < 1e-9
    for bad in (df.limit(0), df.filter("vec_id IN (4, 5, 6, 7, 9)")):
        assert whitening.whiten(bad).count() == 0
    one = whitening.whiten(df.filter("vec_id = 2")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in far}[1] is None


def test_whitening_big_sums_are_exact():
    x = np.array([[2**61, 1], [2**61 - 7, 2], [2**61 + 5, 3]])
    n, sums, _, _ = whitening.summarise(x)
    assert list(sums) == [3 * 2**61 - 2, 6]
    assert whitening.deviations(whitening.Fit(n, [int(s) for s in sums], None, None), x) == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]


# -- token counts


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def merger():
    with open(pieces.default_model(), "rb") as f:
        return token_counts.Merger(f.read())


@needs_tables
def test_tokens_of_the_table(spark, library):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_token_counts(spark, SF).collect()
    assert len(got) == len(text)
    want = dict(zip(text, map(len, library.encode(list(text.values()), num_threads=1))))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), want[i], want[i] > 4096) for i, t in text.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" ▁\n\tabethinrsox.,-!?<s>/0x419鱼龙日本éüß😀\u0000　​  The  "), max_size=60) | st.text(max_size=30).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_tokens_as_the_library(text):
    assert _merger().tokens(text) == len(_library().encode(text))


def _library(have=[]):  # noqa: B006  made once, for hypothesis
    if not have:
        have.append(sp.SentencePieceProcessor(model_file=pieces.default_model()))
    return have[0]


def _merger(have=[]):  # noqa: B006
    if not have:
        with open(pieces.default_model(), "rb") as f:
            have.append(token_counts.Merger(f.read()))
    return have[0]


def test_tokens_odd(spark, library):
    special = "<s> </s> <unk> <0x41> ▁▁ [INST]"
    rows = [(1, None), (2, ""), (3, "   "), (4, special), (4, special), (None, "no id"), (5, "a" * 200_000), (6, "th\n" * 40_000), (7, "鱼" * 5000), (8, "\u0000"), (9, " leading and trailing  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("mine")).withColumn("limit", F.lit(1))
    got = token_counts.token_counts(df).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_a_small_cache_changes_nothing(merger, monkeypatch, library):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2000)
    text = " ".join(f"word{i % 97} thing{i % 13}" for i in range(3000))
    merger.counts.clear()
    assert merger.tokens(text) == len(library.encode(text)) and len(merger.counts) < 50
