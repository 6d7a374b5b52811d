"""Batches of rows of similar length, whose results come back in the old order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import with_row_numbers


def length_class(n: Column, steps: int = 8) -> Column:
    """The length, rounded up to one of ``steps`` (a power of two) for each doubling: at most an eighth more."""
    n = F.greatest(n.cast("long"), F.lit(1))
    bits = F.length(F.bin(n)) - 1 - (steps.bit_length() - 1)
    step = F.expr("1L") * F.pow(F.lit(2), F.greatest(bits, F.lit(0))).cast("long")
    return F.floor((n + step - 1) / step) * step


def fixed_batches(df: DataFrame, length: str, size: int, *order: str) -> DataFrame:
    """Adds ``row`` (the place in the old order) and ``batch``: ``size`` rows each, the longest first."""
    d = with_row_numbers(df, *order, name="row")
    d = with_row_numbers(d, F.col(length).desc(), "row", name="__at")
    return d.withColumn("batch", F.floor(F.col("__at") / size)).drop("__at")


def budget_batches(df: DataFrame, length: str, budget: int, *order: str) -> DataFrame:
    """Adds ``row`` and ``batch``: rows of one length class, as many as ``budget`` holds when each is padded to its class (one at least).

    A batch is named by its class and its number in the class. Rows are sorted in
    ranges; where a class begins is a table with a row a class.
    """
    d = with_row_numbers(df, *order, name="row").withColumn("class", length_class(F.col(length)))
    d = with_row_numbers(d, F.col("class").desc(), F.col(length).desc(), "row", name="__at")
    begin = d.groupBy("class").agg(F.min("__at").alias("__first"))  # eight classes for each doubling
    d = d.join(F.broadcast(begin), "class")
    room = F.greatest(F.floor(F.lit(budget) / F.col("class")), F.lit(1))
    return d.withColumn("batch", F.concat_ws("-", "class", F.floor((F.col("__at") - F.col("__first")) / room))).drop("__at", "__first")


def padding(df: DataFrame, length: str, batch: str) -> DataFrame:
    """One row: rows, batches, the largest batch padded to its longest row, and the share of padding."""
    one = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.sum(length).alias("used"))
    cost = F.col("n") * F.col("longest")
    return one.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("batches"), F.max(cost).alias("largest"), (1 - F.try_divide(F.sum("used"), F.sum(cost))).alias("padding"))


def in_old_order(results: DataFrame, row: str = "row") -> DataFrame:
    """Results of batches, sorted as the rows came (in ranges, each task its own)."""
    return results.orderBy(row)
