"""The nearest word of a vocabulary for each word, by sequence-matcher ratio, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..sources import scratch


def _grams(c: Column, n: int) -> Column:
    """Distinct n-grams of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def nearest_words(words: DataFrame, vocabulary: DataFrame, keys: list[str], word: str = "word", other: str = "other") -> DataFrame:
    """(keys, word, other, ratio): of each distinct word the vocabulary's nearest one under the same keys, the last in order of equals.

    Exact, though few pairs are compared. A word that is in the vocabulary is its
    own nearest. The others meet those that share a piece of ``size`` characters (a
    join on that piece), first of three, then of two, then single ones. Bounds from
    lengths and multisets of characters come first: the most promising partner
    says what a word reaches at least, and only pairs that may reach as much are
    matched. Of a pair without a common piece all blocks are shorter, and between
    two blocks a character of either word is left out, so its ratio isn't above
    ``_without``; words that have found a better one are done and don't go on to
    shorter pieces. Words that share no character with any get the last of the
    vocabulary, with ratio 0. Null words have none, words without a vocabulary
    under their keys are left out, and an empty word is nearest to an empty one.
    """
    w = words.select(*keys, F.col(word).alias("w")).filter("w IS NOT NULL").distinct()
    v = vocabulary.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(other).alias("v")).filter("v IS NOT NULL").distinct()
    w, v = scratch.written(w, "words"), scratch.written(v, "vocabulary")
    named = [F.col(k).alias(f"__{k}") for k in keys]
    same = lambda l, r: [l[k].eqNullSafe(r[f"__{k}"]) for k in keys]

    def without(rest: DataFrame, done: DataFrame) -> DataFrame:
        d = done.select(*named, F.col("w").alias("lw"))
        return rest.join(d, [*same(rest, d), F.col("w") == F.col("lw")], "left_anti")

    found = w.join(v, [*same(w, v), F.col("w") == F.col("v")]).select(*keys, "w", "v", F.lit(1.0).alias("r"))
    rest = scratch.written(without(w, found), "words")
    for size in (3, 2, 1):
        a = rest.select(*keys, "w", F.explode(_grams(F.col("w"), size)).alias("g"))
        b = v.select(*[f"__{k}" for k in keys], "v", F.explode(_grams(F.col("v"), size)).alias("gv"))
        pairs = a.join(b, [*same(a, b), F.col("g") == F.col("gv")]).select(*keys, "w", "v").distinct()
        pairs = scratch.written(pairs.withColumn("most", 2 * _shared("w", "v") / (F.length("w") + F.length("v"))), "pairs")
        tried = pairs.groupBy(*keys, "w").agg(F.max_by("v", F.struct("most", "v")).alias("v")).withColumn("low", sequence.ratio(F.col("v"), F.col("w")))
        tried = tried.select(*named, F.col("w").alias("lw"), "low")
        able = pairs.join(tried, [*same(pairs, tried), F.col("w") == F.col("lw")]).filter("most >= low").select(*keys, "w", "v")
        best = able.withColumn("r", sequence.ratio(F.col("v"), F.col("w"))).groupBy(*keys, "w").agg(F.max(F.struct("r", "v")).alias("b"))
        best = scratch.written(best.select(*keys, "w", "b.v", "b.r"), "best")
        if size > 1:
            best = best.filter(F.col("r") > _without(size, F.length("w")))
        found = found.unionByName(best)
        rest = scratch.written(without(rest, best), "words")
    last = v.groupBy(*[f"__{k}" for k in keys]).agg(F.max("v").alias("last"))
    found = found.unionByName((rest.join(last, same(rest, last)) if keys else rest.crossJoin(F.broadcast(last.filter("last IS NOT NULL")))).select(*keys, "w", F.col("last").alias("v"), F.lit(0.0).alias("r")))
    return found.select(*keys, F.col("w").alias(word), F.col("v").alias(other), F.col("r").alias("ratio"))


def _without(size: int, n: Column) -> Column:
    """What the ratio of a word of n characters can't exceed with a partner of any length m that shares no piece of ``size``.

    Blocks have fewer than ``size`` characters, so M matched ones come in M / (size - 1)
    blocks at least, and n + m - 2M >= M / (size - 1) - 1. With M <= m, too, that is most for m = (n + 1) / (1 + 1 / (size - 1)).
    """
    c = 2 + 1 / (size - 1)
    return 2 * (n + 1) / (c * n + 1)


def _shared(a: str, b: str) -> Column:
    """Characters that two texts have in common, as multisets."""
    many = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x, F.lit("")))
    return F.aggregate(_grams(F.col(a), 1), F.lit(0), lambda s, x: s + F.least(many(a, x), many(b, x)))
