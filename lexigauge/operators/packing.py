"""Sequences packed to a token limit, with attention masks as intervals and positions of picture patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sample import with_row_numbers

#: Rows that are packed by themselves; packs don't go on across such a run.
RUN = 512


def packed(df: DataFrame, length: str, limit: int, *order: str, run: int = RUN) -> DataFrame:
    """Adds ``pack`` and ``begin``: rows in order, one after the other, a new pack where the next row doesn't fit.

    Runs of ``run`` rows are packed apart, so a run is a bounded list and all runs
    are packed at once; a pack is named by its run and its number in it. A row of
    more than ``limit`` is a pack of its own. Null lengths count 0.
    """
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    d = with_row_numbers(df.withColumn("__n", n), *order, name="__row").withColumn("__run", F.floor(F.col("__row") / run))
    cols = [c for c in df.columns]
    lists = d.groupBy("__run").agg(F.array_sort(F.collect_list(F.struct(F.col("__row").alias("r"), F.col("__n").alias("n"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")))).alias("l"))
    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pack:int,begin:bigint>>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["pack"] >= 0) & (s["used"] + x["n"] <= limit)
        pack, begin = F.when(fits, s["pack"]).otherwise(s["pack"] + 1), F.when(fits, s["used"]).otherwise(F.lit(0).cast("long"))
        return F.struct(pack.alias("pack"), (begin + x["n"]).alias("used"), F.concat(s["all"], F.array(F.struct(pack.alias("pack"), begin.alias("begin")))).alias("all"))

    where = F.aggregate("l", start, step, lambda s: s["all"])
    d = lists.select("__run", F.explode(F.arrays_zip(F.col("l"), where.alias("w"))).alias("x"))
    return d.select("x.l.row.*", F.concat_ws("-", "__run", "x.w.pack").alias("pack"), F.col("x.w.begin").alias("begin"))


def attention_runs(splits: DataFrame, sample: str, split: str, length: str, mode: str) -> DataFrame:
    """(sample, split, q_begin, q_end, k_begin, k_end, triangle): which tokens of a sample a split's tokens attend to, as rectangles.

    Modes are ``causal`` (a triangle over its own tokens), ``full`` and ``noise``
    (all its own tokens); every split sees those before it but for noise, which
    only itself sees. Neighbouring splits that are seen alike make one rectangle,
    so a mask has a few rows a split and not the square of its tokens.
    """
    by = Window.partitionBy(sample).orderBy(split)  # the splits of one sample
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    end = F.sum(length).over(by)
    d = splits.select(F.col(sample), F.col(split), F.col(mode).alias("__m"), (end - F.col(length)).alias("q_begin"), end.alias("q_end"))
    # islands: splits without noise between them
    noisy = F.coalesce(F.count_if(F.col("__m") == "noise").over(before), F.lit(0))
    d = d.withColumn("__i", noisy)
    islands = d.filter("__m <> 'noise'").groupBy(F.col(sample).alias("__s"), F.col("__i").alias("__j")).agg(F.min("q_begin").alias("k_begin"), F.max("q_end").alias("__end"))
    seen = d.join(islands, F.col(sample).eqNullSafe(F.col("__s")) & (F.col("__j") <= F.col("__i")) & (F.col("k_begin") < F.col("q_begin")))
    cols = [sample, split, "q_begin", "q_end", "k_begin", "k_end", "triangle"]
    seen = seen.withColumn("k_end", F.least("__end", "q_begin")).withColumn("triangle", F.lit(False)).select(*cols)
    own = d.withColumn("k_begin", F.col("q_begin")).withColumn("k_end", F.col("q_end")).withColumn("triangle", F.col("__m") == "causal").select(*cols)
    return seen.unionByName(own.filter("q_begin < q_end")).filter("q_begin < q_end AND k_begin < k_end")


def patch_positions(height: Column, width: Column, patch: int, side: int, interpolate: bool = False) -> Column:
    """Position of each patch of a picture, row by row, in a square of ``side`` patches: counted from its corner, or spread over all of it."""
    h, w = F.floor(height / patch).cast("int"), F.floor(width / patch).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    at = (lambda i, n: F.floor(i * side / n).cast("int")) if interpolate else (lambda i, n: i)
    return F.flatten(F.transform(upto(h), lambda y: F.transform(upto(w), lambda x: at(y, h) * side + at(x, w))))
