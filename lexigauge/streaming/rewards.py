"""Streaming extensions: windowed reward means and advantages per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reward


def windowed_means(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by event-time window; a window is final once the watermark has passed it."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("start"), key, "n", "mean_value")


def advantages_per_batch(group: str, value: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: group statistics are those of the batch, never cumulative."""
    return lambda df, epoch: sink(reward.grpo_advantage(df, group, value), epoch)
