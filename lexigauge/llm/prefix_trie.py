"""Prefix trie of conversations: MSD radix partitioning over turn ids, multikey quicksort for small buckets.

Turns are dictionary-encoded first: each distinct (role, text) gets a number, by
its SHA-256, so texts are read once and never move. A conversation is then a row
of numbers and text lengths, 12 bytes a turn. ``rebuild`` puts the rows together
as the contract of the query says, and ``trie`` works on rows of any origin.

Equal rows are one row from here on, with the number of its copies and a digest
of their ids: ids are joined in blocks of at most ``BLOCK`` ids, which bounds a
group, and a node's blocks stream through one hash in order, since a digest can't
be computed in parts; a task holds one block at a time.

The trie is cut top down, most significant turn first. A bucket holds the rows
that share a prefix. One with more than ``LOCAL`` turns is large: the longest
prefix that its rows share is that of its smallest and its largest row, its turns
are emitted as nodes, and the rows are dealt to new buckets by the turn behind
it. So a round takes a branching of the trie, however long the shared prefix is.
Only counts per bucket are gathered, partially in each task first; the rows of
large buckets are written for the next round, and no bucket is gathered as long
as it is large. A bucket that isn't, or has one row, is dealt to a task and is
sorted there by multikey quicksort, three ways by the turn at the present depth;
the part with equal turns is a node, which the recursion emits. A task sorts the
whole buckets of an Arrow batch at a time.

Nodes that have the same members follow each other without a branching, and are
handled as one block until the end. Sums over subtrees come from the tasks, with
a bucket's top nodes, and go up from round to round: a table with a row for each
large bucket.

Turns are ordered by their number, null first, and those of equal numbers by a
hash of role and text; repeated rows are turns of their own. Null roles and texts
count as empty ones. Rows without a conversation id belong to no conversation and
are left out. Conversations without turns are members of the root alone; without
any conversation there is no node. Texts may be of any length; a conversation's
turns must fit into a row. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, materialise, new_path, small_side

LOCAL, BLOCK = 8192, 256
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encode(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, id, n): each turn's number in the dictionary and the code points of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), key.alias("key"), F.length(text).alias("n"))
    turns = materialise(turns, "turns")
    dictionary = materialise(turns.groupBy("key").agg(F.max("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    return turns.drop("n").join(dictionary, "key").select("conv_id", "turn", F.xxhash64("key").alias("tie"), "id", "n")


def rebuild(encoded: DataFrame, first: int = 6, family: int = 100) -> DataFrame:
    """(c, ids, chars): the first h turns of the family's first conversation, then the own turns behind the first h."""
    own = encoded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), *[F.col(f) for f in ("turn", "tie", "id", "n")]))).alias("t"))
    own = materialise(own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.n").alias("chars")), "conversations")
    head = own.select(F.col("conv_id").alias("of"), F.slice("ids", 1, first - 1).alias("hi"), F.slice("chars", 1, first - 1).alias("hn"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % first).cast("int")
    d = own.withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % family).join(head, "of", "left")

    def both(theirs: str, mine: str):
        none = F.array().cast(d.schema[mine].dataType)
        rest = F.when(F.size(mine) > F.col("h"), F.slice(mine, F.col("h") + 1, F.size(mine))).otherwise(none)
        return F.concat(F.coalesce(F.slice(theirs, F.lit(1), F.col("h")), none), rest)

    return d.select(F.col("conv_id").alias("c"), both("hi", "ids").alias("ids"), both("hn", "chars").alias("chars"))


def digest_ids(rows: DataFrame) -> DataFrame:
    """(c, w, ends) of rows (key, c): of each key its smallest id, number of ids and SHA-256 of all ids, ascending and comma-joined."""
    block = rows.groupBy("key", F.floor(F.col("c") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list("c")).alias("ids"))  # ids differ: BLOCK at most
    block = block.select("key", F.col("ids")[0].alias("lo"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def stream(batches):
        key = sha = None
        for b in batches:
            out = []
            for k, lo, n, text in zip(*(c.to_pylist() for c in b.columns)):
                if k == key:
                    sha.update(b"," + text.encode())
                    w += n
                else:
                    if key is not None:
                        out.append((c, w, sha.hexdigest()))
                    key, c, w, sha = k, lo, n, hashlib.sha256(text.encode())
            yield _batch(out)
        if key is not None:
            yield _batch([(c, w, sha.hexdigest())])

    return block.repartition("key").sortWithinPartitions("key", "lo").mapInArrow(stream, "c long, w long, ends string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c, w, ends = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(w, pa.int64()), pa.array(ends, pa.string())], ["c", "w", "ends"])


# -- a batch of small buckets


def quicksort(offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of distinct rows ids[offsets[i]:offsets[i + 1]] of at least one turn.

    Gives the order of the rows (a row before those that go on behind it) and the
    blocks of nodes, a block behind the one above it: place of its first row and
    behind its last one in that order, depth of its first and of its last node,
    number of children of its last node, and the block above, -1 for none.
    """
    size, order = np.diff(offsets), np.arange(len(offsets) - 1)
    blocks: list[list[int]] = []
    todo = [(0, len(order), 0, -1)] if len(order) else []  # rows with equal turns up to a depth; the block that they end in

    def turn(rows: np.ndarray, depth: int) -> np.ndarray:
        """Each row's turn behind a depth, -1 where it has ended."""
        return np.where(depth < size[rows], ids[np.minimum(offsets[rows] + depth, len(ids) - 1)], -1)

    while todo:
        lo, hi, depth, above = todo.pop()
        if hi - lo == 1:
            last = int(size[order[lo]])
            if last == depth:
                continue  # ends in the block above
        else:
            rows = order[lo:hi]
            at = turn(rows, depth)
            pivot = at[len(at) // 2]
            less, more = at < pivot, at > pivot
            if less.any() or more.any():
                a, b = lo + int(less.sum()), hi - int(more.sum())
                order[lo:hi] = np.concatenate([rows[less], rows[~(less | more)], rows[more]])
                todo += [(i, j, depth, above) for i, j in ((b, hi), (a, b), (lo, a)) if i < j]
                continue
            last = depth + 1
            while (at := turn(rows, last))[0] >= 0 and (at == at[0]).all():
                last += 1
            todo.append((lo, hi, last, len(blocks)))
        if above >= 0:
            blocks[above][4] += 1
        blocks.append([lo, hi, depth + 1, last, 0, above])
    return order, np.array(blocks, np.int64).reshape(-1, 6)


def nodes_of(rows: pa.Table) -> pa.RecordBatch:
    """Nodes (``NODE`` and whether one is its bucket's top) of whole buckets, whose rows start with the turn that leads to the bucket's top."""
    col = {n: rows.column(n).combine_chunks() for n in rows.column_names}
    num = {n: col[n].to_numpy(zero_copy_only=False) for n in ("depth", "first", "c", "w")}
    up = col["up"].to_numpy(zero_copy_only=False) if not col["up"].null_count else col["up"].fill_null(0).to_numpy(zero_copy_only=False)
    offsets, ids, chars = col["ids"].offsets.to_numpy(), col["ids"].values.to_numpy(zero_copy_only=False), col["chars"].flatten().to_numpy(zero_copy_only=False)
    ids, offsets = ids[offsets[0] : offsets[-1]].copy(), (offsets - offsets[0]).astype(np.int64)
    new = np.ones(len(up), bool)
    new[1:] = (num["first"][1:] != num["first"][:-1]) | (num["depth"][1:] != num["depth"][:-1]) | (up[1:] != up[:-1])
    ids[offsets[:-1]] = np.cumsum(new)  # a bucket is told by its first turn, which it doesn't share with another one then
    order, blocks = quicksort(offsets, ids)
    lo, hi, top, last, children, above = blocks.T
    lead, c = order[lo], num["c"][order]
    members, total, start = np.cumsum(np.append(0, num["w"][order])), np.cumsum(np.append(0, chars.astype(np.int64))), offsets[lead]
    n, smallest = members[hi] - members[lo], np.array([c[i:j].min() for i, j in zip(lo, hi)], np.int64)
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * (total[start + last] - total[start + top - 1])
    for i in range(len(blocks) - 1, 0, -1):
        if above[i] >= 0:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    long = last - top + 1
    of = np.repeat(np.arange(len(blocks)), long)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long) + top[of]
    is_top, is_last = depth == top[of], depth == last[of]
    before = (n[of] - 1) * (total[start[of] + depth - 1] - total[start[of] + top[of] - 1])  # of the block's nodes above this one
    ends = is_last & (offsets[lead + 1] - start == last)[of]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(smallest[of]), pa.array(num["depth"][lead][of] + depth - 1), pa.array(np.where(is_top, np.where(above[of] >= 0, smallest[above[of]], up[lead][of]), smallest[of])),
            pa.array(n[of]), pa.array(np.where(is_last, children[of], 1)), pa.array(leaves[of]), pa.array(saved[of] - before),
            col["ends"].take(pa.array(lead[of], mask=~ends)).fill_null(NONE), pa.array(is_top & (above[of] < 0)),
        ],
        [f.split()[0] for f in f"{NODE}, top boolean".split(", ")],
    )


def finish(batches):
    """Nodes of buckets that follow each other; the last bucket of a batch waits for the next batch."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        other = np.zeros(t.num_rows, bool)
        for name in ("up", "depth", "first"):
            v = t.column(name).to_numpy()
            other |= v != v[-1]
        cut = int(other.nonzero()[0][-1]) + 1 if other.any() else 0
        if cut:
            yield nodes_of(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield nodes_of(rest)


# -- the trie


def trie(rows: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes (``NODE``) of rows (c, ids, chars): an id, the numbers of its turns and the lengths of their texts."""
    spark = rows.sparkSession
    done: list[str] = []
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))
    rows = materialise(rows.select("c", "ids", "chars"), "rows", done)
    distinct = rows.join(digest_ids(rows.select(key.alias("key"), "c")), "c")
    # the root's bucket, whose rows all begin with a turn without text
    ahead = lambda name, value: F.concat(F.array(F.lit(value)).cast(rows.schema[name].dataType), F.col(name)).alias(name)
    big = distinct.select(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("up"), "c", "w", "ends", ahead("ids", 0), ahead("chars", 0))
    big = materialise(big, "distinct", done)
    levels, small = [], []
    while True:
        shared, big_children, dealt = _round(big, local)
        levels.append(shared)
        small.append(dealt.filter("NOT large"))
        if big_children.isEmpty():
            break
        big = dealt.filter("large")
    here = reduce(DataFrame.unionAll, [d.select("up", "depth", "first", "c", "w", "ends", "ids", "chars") for d in small])
    here = here.repartition("up", "depth", "first").sortWithinPartitions("up", "depth", "first")
    below = materialise(here.mapInArrow(finish, f"{NODE}, top boolean"), "nodes")
    discard(spark, done)
    tops = below.filter("top").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("last"), "n_leaves", "saved_tokens")
    sums = materialise(tops.groupBy("conv_id", "last").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")
    found, above = [below.drop("top")], None
    for shared in reversed(levels):
        under = (sums if above is None else sums.unionByName(above)).groupBy("conv_id", "last").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
        s = materialise(shared.join(under, ["conv_id", "last"], "left").withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1))).withColumn("under", F.coalesce("under", F.lit(0))), "sums")
        found.append(_chain(s))
        saved = F.col("under") + (F.col("n_convs") - 1) * F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
        above = s.filter("up IS NOT NULL").select(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("last"), "n_leaves", saved.alias("saved_tokens"))
    return reduce(DataFrame.unionByName, found)


def _round(big: DataFrame, local: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One branching of each large bucket: its shared turns, its large children, its rows with the bucket that they fall in."""
    spark = big.sparkSession
    ends_of = big.groupBy("b", "depth", "up").agg(F.min("c").alias("conv_id"), F.sum("w").alias("n_convs"), F.min(F.struct("ids", "chars")).alias("lo"), F.max("ids").alias("hi"))
    differs = F.array_position(F.transform(F.arrays_zip(F.col("lo.ids").alias("x"), F.col("hi").alias("y")), lambda p: p.x.eqNullSafe(p.y)), F.lit(False))
    shared = ends_of.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("hi")).cast("int"))
    shared = materialise(shared.select("b", "depth", "up", "conv_id", "n_convs", "n", F.slice("lo.chars", F.lit(1), F.col("n")).alias("chars")), "shared")
    at = shared.select("b", "depth", "n", F.col("conv_id").alias("m"))
    rows = big.drop("up").join(small_side(at)(at), ["b", "depth"]).withColumn("first", F.get("ids", F.col("n")))
    turns = F.sum(F.size("ids") - F.col("n"))
    children = rows.groupBy("b", "depth", "first").agg(F.min("c").alias("child"), F.max(F.when(F.col("first").isNull(), F.col("ends"))).alias("ends"), ((turns > local) & (F.count(F.lit(1)) > 1)).alias("large"))
    children = materialise(children, "children")
    each = children.groupBy("b", "depth").agg(F.count("first").alias("n_children"), F.max("ends").alias("ends_sha256"))
    large = children.filter("first IS NOT NULL AND large").select(F.col("b").alias("lb"), F.col("depth").alias("ld"), F.col("first").alias("lf"), "child")
    go_on = rows.filter("first IS NOT NULL").join(small_side(large)(large), F.expr("b = lb AND depth = ld AND first = lf"), "left")
    behind = lambda name: F.expr(f"slice({name}, n + 1, size({name}))").alias(name)
    go_on = go_on.select(F.col("child").alias("b"), (F.col("depth") + F.col("n")).alias("depth"), F.col("m").alias("up"), "first", "c", "w", "ends", behind("ids"), behind("chars"), F.col("child").isNotNull().alias("large"))
    dealt_at = new_path(spark, "dealt")
    go_on.write.partitionBy("large").parquet(dealt_at)
    dealt = spark.read.schema(go_on.schema).parquet(dealt_at)
    shared = shared.join(each, ["b", "depth"]).withColumn("last", F.col("depth") + F.col("n") - 1).drop("b", "n")
    return shared, large, dealt


def _chain(s: DataFrame) -> DataFrame:
    """Nodes of the shared turns of large buckets."""
    d = s.select("*", F.posexplode("chars").alias("at", "n")).withColumn("at", F.col("depth") + F.col("at"))
    from_here = F.sum(F.col("n").cast("long")).over(Window.partitionBy("conv_id", "depth").orderBy(F.desc("at")))  # a bucket's shared turns: those of one conversation at most
    last = F.col("at") == F.col("last")
    return d.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("under") + (F.col("n_convs") - 1) * from_here).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends_sha256")), F.lit(NONE)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, local: int = LOCAL, first: int = 6, family: int = 100) -> DataFrame:
    """Nodes (``NODE``) of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuild(encode(conversations), first, family), local)
