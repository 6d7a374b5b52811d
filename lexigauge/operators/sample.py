"""Deterministic sampling: the same rows for a seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def with_row_numbers(df: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """Adds the place of each row in an order, from 0, without gathering rows in one task.

    Rows are sorted in ranges and written once; a range's first place is the
    number of rows in the ranges before, of which there are as many as tasks.
    """
    s = df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    s = scratch.written(s, "rows")
    ends = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = ends.withColumn("__s", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")  # one row a range
    return s.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")


def order_key(key: str, seed: int) -> Column:
    """A hash that any engine can reproduce."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the first by hash (a top-n, not a full sort)."""
    return df.orderBy(order_key(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(order_key(key, seed), key)


def k_repeat(df: DataFrame, key: str, ranks: int, batch: int, k: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """ranks x batch rows: m prompts k times each, shuffled and dealt to ranks. The sample's size is a parameter, so one task may order it."""
    if ranks * batch % k:
        raise ValueError("ranks x batch must be divisible by k")
    some = fixed_sample(df.select(key), key, ranks * batch // k, seed + epoch)
    rows = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
    at = F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), "copy", F.lit(str(seed + epoch)))), key, "copy")) - 1
    return rows.withColumn("slot", at).withColumn("rank", F.floor(F.col("slot") / batch).cast("int"))


def largest_remainder(df: DataFrame, weight: str, total: int, *ties: str) -> DataFrame:
    """Adds quota: whole shares of ``total`` by weight, what is left to the largest fractions. For a table of tasks."""
    s = df.crossJoin(F.broadcast(df.agg(F.sum(weight).alias("__sum"))))
    exact = F.col(weight) * total / F.col("__sum")
    s = s.withColumn("__floor", F.floor(exact).cast("long")).withColumn("__frac", F.round(exact - F.floor(exact), 9))
    s = s.crossJoin(F.broadcast(s.agg((F.lit(total) - F.sum("__floor")).alias("__left"))))
    nth = F.row_number().over(Window.orderBy(F.col("__frac").desc(), *ties))
    return s.withColumn("quota", F.col("__floor") + (nth <= F.col("__left")).cast("long")).drop("__sum", "__floor", "__frac", "__left")


def sample_k(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows: without replacement where there are enough, else drawn again and again, which needs fewer than k numbered rows."""
    n = df.count()
    if n >= k or n == 0:
        return fixed_sample(df, key, k, seed)
    rows = with_row_numbers(df, order_key(key, seed), key, name="__at")
    draws = df.sparkSession.range(k).select(F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(n)).alias("__at"))
    return draws.join(rows, "__at").drop("__at")


def hash_seed(s: Column, base: int = 0) -> Column:
    """First four bytes of SHA-256, plus a base, modulo 2**31."""
    return F.pmod(F.conv(F.substring(F.sha2(s, 256), 1, 8), 16, 10).cast("long") + base, F.lit(2147483648))


def round_robin(df: DataFrame, n: int, *order: str) -> DataFrame:
    return with_row_numbers(df, *order, name="__r").withColumn("rank", F.pmod("__r", F.lit(n))).drop("__r")


def composition_parts(s: Column, seed: Column) -> Column:
    """Splits an integer s into random positive parts that sum to it: a cut after each place whose hash is even."""
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(s, F.lit(1))), lambda i: (i == s) | (F.pmod(F.xxhash64(i, seed), F.lit(2)) == 0))
    return F.transform(cuts, lambda c, i: c - F.coalesce(F.get(cuts, i - 1), F.lit(0)))


def draw(seed: Column, salt: int) -> Column:
    """A number of 32 bits that any engine can reproduce: the first digits of the MD5 of ``seed:salt``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.lit(str(salt)))), 1, 8), 16, 10).cast("long")


def choose(values: list[str], seed: Column, salt: int = 0) -> Column:
    """One of the values by hash."""
    return F.element_at(F.array(*map(F.lit, values)), (draw(seed, salt) % len(values) + 1).cast("int"))


def composed_prompts(seed: Column, subjects: list[str], activities: list[str]) -> Column:
    """A subject with its article and an activity, by hash."""
    noun = choose(subjects, seed)
    return F.concat_ws(" ", F.when(F.lower(noun).rlike("^[aeiou]"), "an").otherwise("a"), noun, choose(activities, seed, 1))


def counted_prompts(seed: Column, subjects: list[str], low: int = 2, high: int = 9) -> Column:
    """A number of subjects, by hash."""
    n = draw(seed, 3) % (high - low + 1) + low
    return F.concat_ws(" ", n.cast("string"), F.concat(choose(subjects, seed), F.lit("s")))


def sign_prompts(seed: Column, subjects: list[str], most: int = 9) -> Column:
    """A subject that holds a sign with 1 to ``most`` sixes."""
    n = (draw(seed, 2) % most + 1).cast("int")
    return F.concat(F.lit("A "), choose(subjects, seed), F.lit(' holding a sign that says "'), F.repeat(F.lit("6"), n), F.lit('"'))


#: Prompt functions by name: (seed, subjects, activities) to a prompt.
PROMPTS = {
    "activity": composed_prompts,
    "count": lambda seed, subjects, activities: counted_prompts(seed, subjects),
    "sign": lambda seed, subjects, activities: sign_prompts(seed, subjects),
    "subject": lambda seed, subjects, activities: choose(subjects, seed),
}


def prompts(df: DataFrame, kind: str, seed: str, subjects: list[str], activities: list[str] = (), out: str = "prompt") -> DataFrame:
    """Adds a random prompt of a registered kind, the same for the same seed."""
    if kind not in PROMPTS:
        raise ValueError(f"no prompts {kind}; there are {', '.join(PROMPTS)}")
    return df.withColumn(out, PROMPTS[kind](F.col(seed), list(subjects), list(activities) or [""]))


def dealt(df: DataFrame, parts: int, out: str, *order: str) -> DataFrame:
    """Contiguous parts of nearly equal sizes, the first ones larger by one."""
    n = df.count()
    size, more = divmod(n, parts)
    r = F.col("__r")
    first = F.floor(r / F.lit(size + 1))
    later = F.lit(more) + F.floor((r - more * (size + 1)) / F.lit(max(size, 1)))
    return with_row_numbers(df, *order, name="__r").withColumn(out, F.when(r < more * (size + 1), first).otherwise(later).cast("int")).drop("__r")


def near_equal_parts(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Batches of at most ``size`` rows and nearly equal sizes, for calls to an external scorer."""
    return dealt(df, max(1, -(-df.count() // size)), "batch", *order)
