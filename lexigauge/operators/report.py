"""Presentation: fixed column order, fixed digits, NA for gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_table(df: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """One row for each ``row``, one column for each of ``order``, in that order; null where there is none."""
    return df.groupBy(row).pivot(column, order).agg(F.first(value)).select(row, *[F.col(f"`{c}`") for c in order])


def as_text(df: DataFrame, columns: list[str], digits: int = 3, gap: str = "NA") -> DataFrame:
    """Numbers as text, halves to even as the decimal digits show them, gaps as ``NA``."""
    return df.withColumns({c: F.when(F.col(f"`{c}`").isNull(), gap).otherwise(F.format_string(f"%.{digits}f", F.bround(F.col(f"`{c}`"), digits))) for c in columns})


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """Best first, ties by name."""
    return df.orderBy(F.col(by).desc(), name)


def grid(n: int, width, height):
    """Array of (row, col, left, top, right, bottom) of an n by n cut with whole pixels."""
    w, h = F.floor(width / n), F.floor(height / n)
    cells = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.struct(F.floor(i / n).alias("row"), (i % n).alias("col")))
    return F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), (c["col"] * w).alias("left"), (c["row"] * h).alias("top"), ((c["col"] + 1) * w).alias("right"), ((c["row"] + 1) * h).alias("bottom")))
