"""Lookups as joins. Catalyst picks the strategy; a small side is broadcast by its size statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import with_row_numbers


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key, the last in the order, as repeated keys of a dictionary."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__v")).select(key, *[F.col(f"__v.`{c}`").alias(c) for c in cols])


def lookup_join(files: DataFrame, prompts: DataFrame, key: str, on_missing: str = "skip") -> DataFrame:
    """``error``: a file without prompt fails the query; ``skip``: it is left out; ``null``: it stays without one."""
    if on_missing == "skip":
        return files.join(prompts, key, "inner")
    out = files.join(prompts.withColumn("__found", F.lit(True)), key, "left")
    if on_missing == "error":
        out = out.filter(F.coalesce(F.col("__found"), F.raise_error(F.concat(F.lit(f"no prompt for {key} "), F.col(key).cast("string")))))
    elif on_missing != "null":
        raise ValueError(on_missing)
    return out.drop("__found")


def exactly_one(items: DataFrame, files: DataFrame, key: str, value: str) -> DataFrame:
    """Each item with the value of its file, null unless there is exactly one."""
    one = files.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias(value))
    return items.join(one, key, "left").withColumn(value, F.when(F.col("__n") == 1, F.col(value))).drop("__n")


def minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key isn't in b; repeats stay."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def gather(rows: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """Rows picked by index, as often and in the order (``pos``) that picks name them."""
    return picks.join(rows, key).orderBy("pos")


def prefixed_lookup(scores: DataFrame, meta: DataFrame, key: str, prefixes: dict[str, str]) -> DataFrame:
    """Joins ``prefix_id`` keys with metadata on (category, id)."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    s = scores.withColumn("category", table[F.split_part(F.col(key), F.lit("_"), F.lit(1))]).withColumn("id", F.split_part(F.col(key), F.lit("_"), F.lit(2)))
    return s.join(meta, ["category", "id"])


def pairs_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """All pairs i < j of a group (columns suffixed _1 and _2); meant for groups of a fixed small size, as images of a prompt."""
    a, b = (df.select(F.col(group), *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != group]) for k in (1, 2))
    return a.join(b, group).filter(F.col(f"{order}_1") < F.col(f"{order}_2"))


def not_done(items: DataFrame, done: DataFrame, key: str, repeats: int = 1, repeat: str = "repeat") -> DataFrame:
    """Items that don't have all their repeats yet."""
    full = done.groupBy(key).agg(F.countDistinct(repeat).alias("__n")).filter(F.col("__n") >= repeats).select(key)
    return items.join(full, key, "left_anti")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``name``_0, ``name``_1, ... in the order given."""
    return with_row_numbers(df, *order, name="__r").withColumn("id", F.concat(F.lit(f"{name}_"), F.col("__r").cast("string"))).drop("__r")


def whitelist(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows with one of the values; all rows where no list is given."""
    return df if values is None else df.filter(F.col(column).isin(values))


def with_default(df: DataFrame, other: DataFrame, key: str, value: str, default: float = 0.0) -> DataFrame:
    return df.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def token_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Every token of one list beside every token of the other, row by row; for inspection of short lists."""
    return df.select(key, F.explode(a).alias("x"), b).select(key, "x", F.explode(b).alias("y"))


def distinct_values(frames: list[DataFrame], *columns: str) -> DataFrame:
    """The different values of columns that several tables have, sorted in ranges; each table drops its repeats before they meet."""
    parts = [f.select(*columns).distinct() for f in frames]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy(*columns)


def concat_chunks(frames: list[DataFrame]) -> DataFrame:
    """Rows of all chunks, with the chunk's number; columns that a chunk lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("chunk", F.lit(i)) for i, f in enumerate(frames)])


def transposed(df: DataFrame, key: str, columns: list[str], name: str = "name", pos: str = "pos", value: str = "value") -> DataFrame:
    """Lists side by side as rows (key, pos, name, value): what stands at one place of all lists, up to the shortest one."""
    n = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    zipped = F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(c) for c in columns])
    d = df.select(key, F.posexplode(zipped).alias(pos, "__r"))
    return d.select(key, pos, *[F.col(f"__r.`{c}`").alias(c) for c in columns]).unpivot([key, pos], columns, name, value)
