"""Scans along an order, in which each row's value depends on the one before, without a task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .sample import with_row_numbers

#: Rows of a key that are folded in one list.
CHUNK = 128


def with_places(df: DataFrame, keys: list[str], order: list[str], name: str = "at") -> DataFrame:
    """Adds a row's place in the order of its key, from 0. Rows are numbered in sorted ranges, so a key may have any share of them."""
    d = with_row_numbers(df, *keys, *order, name="__row")
    first = d.groupBy(*keys).agg(F.min("__row").alias("__begin"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    first = first.select("__begin", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return d.join(first, same).withColumn(name, F.col("__row") - F.col("__begin")).drop("__row", "__begin", *[f"__k{i}" for i in range(len(keys))])


def _then(m: Column, x: Column) -> Column:
    """The map v -> a v + b of ``m`` and then that of ``x``."""
    return F.struct((m["a"] * x["a"]).alias("a"), (m["b"] * x["a"] + x["b"]).alias("b"))


def _entries(maps: DataFrame, starts: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """``maps`` (keys, at, a, b and other columns) with ``entry``, the value that reaches each.

    Each key's maps are folded in chunks of neighbours; the chunks' own maps are
    far fewer and get their entries in the same way, and a chunk's entry is then
    carried through its maps. ``starts`` (keys, start) says where a key begins.
    """
    most = maps.agg(F.max("at")).first()[0]
    rest = [c for c in maps.columns if c not in keys]
    d = maps.groupBy(*keys, F.floor(F.col("at") / chunk).alias("__c")).agg(F.array_sort(F.collect_list(F.struct("at", *[c for c in rest if c != "at"]))).alias("l"))
    if most is None or most < chunk:
        d = d.join(starts, keys, "left").withColumnRenamed("start", "__e")
    else:
        d = scratch.written(d, "chunks")
        whole = F.aggregate("l", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), _then)
        above = d.select(*keys, F.col("__c").alias("at"), whole.alias("m")).select(*keys, "at", "m.a", "m.b")
        above = _entries(above, starts, keys, chunk).select(*keys, F.col("at").alias("__c"), F.col("entry").alias("__e"))
        d = d.join(above, [*keys, "__c"])
    carried = F.aggregate("l", F.struct(F.col("__e").cast("double").alias("v"), F.array().cast("array<double>").alias("all")), lambda s, x: F.struct((s["v"] * x["a"] + x["b"]).alias("v"), F.concat(s["all"], F.array(s["v"])).alias("all")), lambda s: s["all"])
    d = d.select(*keys, F.explode(F.arrays_zip("l", carried.alias("entry"))).alias("x"))
    return d.select(*keys, *[F.col(f"x.l.`{c}`").alias(c) for c in rest], F.col("x.entry").alias("entry"))


def affine_scan(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column, starts: DataFrame, out: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the value v = a v + b along the order of each key, from its ``start``; ``a`` and ``b`` may use the place ``at``.

    The maps of neighbours compose to one, so ranges are composed first and filled
    in afterwards: no list is longer than ``chunk``, however many rows a key has.
    Keys have no nulls; ties in the order are broken by nothing, so give a whole one.
    Columns of ``df`` may have any name but ``at`` where the maps use the place.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    d = with_places(df.withColumn("__rest", rest), keys, order)
    maps = d.select(*keys, "at", F.col("__rest").alias("row"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    done = _entries(maps, starts, keys, chunk)
    return done.select(*keys, F.col("row.*"), (F.col("a") * F.col("entry") + F.col("b")).alias(out))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, every: int = 1, out: str = "ema", chunk: int = CHUNK) -> DataFrame:
    """Adds the moving average of a key's rows up to each: decay min((1 + s) / (10 + s), decay), updated every k steps s.

    It starts from the key's first value; a null value leaves it as it was.
    """
    keep = F.least((1 + F.col("at")) / (10 + F.col("at")), F.lit(decay))
    moves = ((F.col("at") + 1) % every == 0) & F.col(value).isNotNull()
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("start"))
    return affine_scan(df, keys, order, F.when(moves, keep).otherwise(1.0), F.when(moves, (1 - keep) * F.col(value)).otherwise(0.0), first, out, chunk)
