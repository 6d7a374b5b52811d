"""Writers: JSON lines, CSV, idempotent and resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException

from ..operators import joins


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Quotes are doubled and white space at the ends stays, so any text comes back as it was."""
    df.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def once(df: DataFrame, path: str) -> None:
    """Nothing is done where the output is there already."""
    df.write.mode("ignore").json(path)


def remaining(items: DataFrame, path: str, key: str) -> DataFrame:
    """Items that an earlier, perhaps broken off run hasn't written."""
    try:
        done = items.sparkSession.read.schema(f"`{key}` {items.schema[key].dataType.simpleString()}").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return items
    return joins.minus(items, done, key)


def resume(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't in the output yet."""
    remaining(df, path, key).write.mode("append").json(path)
