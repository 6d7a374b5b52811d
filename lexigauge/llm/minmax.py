"""Near-duplicate documents by min-max hashing.

Words are what ASCII white space leaves of a text whose A-Z are lower-cased; a
document's set holds its distinct word shingles. Each of ``perms`` permutations
is evaluated once for a shingle, and both its minimum and its maximum over the
set are kept: two unbiased coordinates for one evaluation. ``rows`` coordinates
make a band. Two documents of similarity s share one of ``bands`` bands with
probability 1 - (1 - s**rows)**bands: 0.99999 at 0.8 for the defaults.

1. One pass over the texts gives each document's set size, set digest and band
   keys. Documents with one digest are one class; only classes go on, so a
   group of copies costs one row.
2. In each bucket every class is compared with the bucket's smallest, a star in
   place of all pairs. Full sets are compared, not signatures. The first
   bands go first; in the others only classes that are still apart are compared.
3. Classes of one bucket that are still in different components are compared
   too. The classes of buckets of more than a block are first dealt out by
   prefixes: of each class the shingles that are rarest among all these, so many
   that two similar sets must share one of them. That drops no link, moves each set once, and
   leaves nothing where many texts share a frame but differ enough. What still
   meets is compared in blocks of bounded size; only links that join components
   are emitted, never pairs.
4. The links make components; each component gets its smallest doc_id.

Texts are read twice and moved once, for the classes that share a bucket.

Null or blank texts have the empty set and no links. Fewer words than a
shingle needs make one shingle. A row with a null id is linked with nothing, has
no component and is kept. A class is known by 64 bits of its digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep_rows, materialise, small_side, text_key
from .graph import components, with_links

PERMS, ROWS, BANDS = 168, 7, 48
FIRST_BANDS = 4
BLOCK = 512
WORDS_CACHED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_cache: dict[bytes, int] = {}


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if len(_cache) > WORDS_CACHED:
        _cache.clear()
    get, put = _cache.get, xxhash.xxh3_64_intdigest
    codes = [get(w) or _cache.setdefault(w, put(w)) for w in words]
    h = np.array(codes, np.uint64)
    m = min(k, n)
    s = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        s = s * _MIX + h[i : n - m + 1 + i]
    return np.unique(_finish(s))


def _lanes(seed: int, perms: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, perms, dtype=np.uint32)


def band_keys(s: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Keys of the bands of a non-empty set; each permutation gives its minimum and its maximum."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo, hi = np.full(len(a), 2**32 - 1, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 512):  # a block of hashes at a time stays in the cache
        y = a[:, None] * x[None, i : i + 512]
        y += b[:, None]
        np.minimum(lo, y.min(1), out=lo)
        np.maximum(hi, y.max(1), out=hi)
    v = np.stack([lo, hi], 1).reshape(-1)[: rows * bands].astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for j in range(rows):
        key = _finish(key ^ v[:, j]) * _MIX
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, perms: int, rows: int, bands: int, seed: int) -> DataFrame:
    """(doc_id, tkey, n, node, keys) of each row; node and keys are null for the empty set."""
    assert 2 * perms >= rows * bands

    def run(batches):
        a, b = _lanes(seed, perms)
        for batch in batches:
            n, node, keys = [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                keys.append(band_keys(s, a, b, rows, bands) if len(s) else None)
            flat = [x for x in keys if x is not None]
            off = np.cumsum([0] + [0 if x is None else bands for x in keys]).astype(np.int32)
            vals = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(off), vals)], ["doc_id", "tkey", "n", "node", "keys"])

    return docs.mapInArrow(run, "doc_id long, tkey long, n long, node long, keys array<long>")


def class_sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(node, n, s): the full set of each class, from the document (doc_id, tkey) that stands for it."""
    one = classes.select("node", F.col("doc_id").alias("__i"), F.col("tkey").alias("__k"))
    d = docs.join(one, (docs["doc_id"] == one["__i"]) & (docs["tkey"] == one["__k"])).select("node", "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # a part's sets are in memory at a time
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), k) for t in part.column(1)]
                off = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                vals = pa.array(np.concatenate([x.view(np.int64) for x in sets]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off), vals)], ["node", "n", "s"])

    return d.mapInArrow(run, "node long, n long, s array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, both sizes known to allow it) whose full sets are similar enough."""
    x, y = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(same * 100 >= (F.size("sa") + F.size("sb") - same) * percent).select("a", "b")


def _joined(node: np.ndarray, label: np.ndarray, side: np.ndarray, off: np.ndarray, flat: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different components among the rows of one block pair; no more than join them."""
    m, sizes = len(node), np.diff(off)
    _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    own, many = np.repeat(np.arange(m), sizes), count[inv] > 1
    _, inv = np.unique(inv[many], return_inverse=True)
    own, order = own[many], np.argsort(inv, kind="stable")
    inv, own, same = inv[order], own[order], np.zeros((m, m), np.float32)
    for at in range(0, int(inv[-1]) + 1 if len(inv) else 0, 4096):
        lo, hi = np.searchsorted(inv, [at, at + 4096])
        block = np.zeros((m, 4096), np.float32)
        block[own[lo:hi], inv[lo:hi] - at] = 1
        same += block @ block.T
    ok = same * 100 >= percent * (sizes[:, None] + sizes[None, :] - same)
    ok &= label[:, None] != label[None, :]
    if side.min() != side.max():
        ok &= side[:, None] != side[None, :]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x] = up.get(up[x], up[x])
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1))):
        x, y = top(int(label[i])), top(int(label[j]))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(node[i]), int(node[j])))
    return out


def by_prefix(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, label) of ``nodes`` (node, label) dealt out by rare shingles: similar sets share a key.

    A set of n shingles has at least percent of n in common with a similar one,
    so among any n - that + 1 of its shingles one is common. Taken in the order
    of their frequency among the nodes, they are mostly nobody else's. Each step
    is linear in the sizes of the sets.
    """
    x = nodes.join(sets.select("node", "s"), "node").select("node", "label", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = x.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = materialise(x.join(often, "x"), "shared")
    own = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))  # shingles that nobody else has come first
    nth = own + F.row_number().over(Window.partitionBy("node").orderBy("c", "x"))
    within = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = shared.withColumn("nth", nth).filter(F.col("nth") <= within)
    kept = materialise(kept.select(F.xxhash64(F.lit("prefix"), "x").alias("key"), "node", "label"), "prefixes")
    open_ = kept.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return kept.join(open_, "key", "left_semi")


def open_links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between components within a bucket; ``members``: (key, node, label).

    Buckets of more than a block are dealt out by prefixes first. What is still
    larger is dealt into blocks, and every pair of blocks is one piece of work
    of bounded size. Pairs aren't emitted: intersections come from products of
    membership matrices, and only links that join components leave.
    """
    members = members.select("key", "node", "label")

    def sized(m: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        # only buckets beyond one block need a number of blocks, so rows stay where they are
        large = materialise(m.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")).filter("nb > 1"), name)
        return m, small_side(large)(large)

    members, large = sized(members, "large")
    if not large.isEmpty():
        dealt = by_prefix(members.join(large.select("key"), "key", "left_semi").select("node", "label").distinct(), sets, percent)
        members, large = sized(materialise(members.join(large, "key", "left_anti").unionByName(dealt).distinct(), "dealt"), "large")
    m = members.join(large, "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    m = m.withColumn("side", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("side", j).alias("lo"), F.greatest("side", j).alias("hi")))
    m = m.select("key", "node", "label", "side", F.explode(pairs).alias("p")).select("key", "p.lo", "p.hi", "node", "label", "side")
    m = m.join(sets.select("node", "s"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def groups(batches):
        kept, now = [], None
        for b in batches:
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)] if len(k) else [0]
            for i, j in zip(cuts, cuts[1:]):
                if now is not None and now != tuple(k[i]):
                    yield kept
                    kept = []
                now = tuple(k[i])
                kept.append(b.slice(i, j - i))
        if kept:
            yield kept

    def run(batches):
        for g in groups(batches):
            t = pa.Table.from_batches(g).combine_chunks()
            if t.num_rows < 2:
                continue
            node, label, side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
            s = t.column("s").chunk(0)
            off = s.offsets.to_numpy().astype(np.int64)
            found = _joined(node, label, side, off - off[0], s.values.to_numpy()[off[0] : off[-1]], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return m.select("key", "lo", "hi", "node", "label", "side", "s").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, perms: int = PERMS, rows: int = ROWS, bands: int = BANDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept), one row per input row.

    Linked: at least ``percent`` percent of the union of two sets is shared.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    sig = materialise(signatures(docs, k, perms, rows, bands, seed), "signatures")
    known = sig.filter("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("d"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = materialise(classes.select("node", "d.doc_id", "d.tkey", "n", "keys"), "classes")
    rowsets = classes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = rowsets.groupBy("key").agg(F.min("node").alias("c"), F.max("node").alias("z")).filter("c <> z").select("key", "c")
    members = materialise(rowsets.join(shared, "key"), "members")
    fits = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * percent)  # noqa: E731  sizes too far apart can't be similar
    sets = materialise(class_sets(docs, classes.join(members.select("node").distinct(), "node", "left_semi"), k), "sets")
    size = classes.select(F.col("node").alias("c"), F.col("n").alias("m"))
    comp = tried = None
    for most in (FIRST_BANDS, bands):  # a few bands join most near copies, so the others need few comparisons
        stars = members.filter((F.col("band") < most) & (F.col("node") != F.col("c"))).select("c", "node", "n").distinct()
        if comp is not None:
            mine, its = comp.select("node", F.col("label").alias("l1")), comp.select(F.col("node").alias("c"), F.col("label").alias("l2"))
            stars = stars.join(mine, "node", "left").join(its, "c", "left").filter(F.coalesce("l1", "node") != F.coalesce("l2", "c"))
        stars = stars.join(size, "c").filter(fits(F.col("n"), F.col("m"))).select(F.col("c").alias("a"), F.col("node").alias("b"))
        stars = materialise(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
        tried = stars if tried is None else tried.union(stars)
        found = materialise(confirmed(stars, sets, percent), "links")
        comp = components(found) if comp is None else with_links(comp, found)
    m = members.select("key", "node", "n").join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    m = materialise(m.join(open_, "key", "left_semi"), "open")
    more = materialise(open_links(m, sets, percent), "links")
    if not more.isEmpty():
        comp = with_links(comp, more)
    firsts = classes.select("node", F.col("doc_id").alias("first")).join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = firsts.groupBy("label").agg(F.min("first").alias("component"))
    named = firsts.join(least, "label").select("node", "component")
    out = sig.select("doc_id", "tkey", "n", "node").join(named, "node", "left")
    comp_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept"))


def keep_distinct(docs: DataFrame, k: int = 5) -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``."""
    return keep_rows(docs, near_duplicates(docs, k=k))
