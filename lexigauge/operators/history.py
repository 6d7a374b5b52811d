"""Prompts seen in the batches of a training run: sizes of groups in a batch, and how many prompts there were ever."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def prompt_history(df: DataFrame, batch: str, prompt: str) -> DataFrame:
    """For each batch its mean group size, prompts, prompts never seen before, and prompts seen up to it."""
    groups = df.groupBy(batch, prompt).agg(F.count(F.lit(1)).alias("n"))
    per = groups.groupBy(batch).agg(F.avg("n").alias("mean_size"), F.count(F.lit(1)).alias("prompts"))
    new = groups.groupBy(prompt).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("new_prompts"))
    d = per.join(new, batch, "left").withColumn("new_prompts", F.coalesce("new_prompts", F.lit(0)))
    return d.withColumn("ever", F.sum("new_prompts").over(Window.orderBy(batch)))  # one row a batch


class PromptHistory:
    """The same for batches that come one after the other: what was seen is a table that outlives them, and restarts.

    A batch appends the prompts that no earlier one had, and a row of statistics
    with a sketch of its prompts. Both are written under the batch's number, so a
    batch that is run again after a failure replaces what it had written and
    counts nothing twice. Sketches merge: ``report`` also estimates from them
    alone, which needs no look-up of earlier prompts.
    """

    def __init__(self, spark: SparkSession, path: str, prompt: str) -> None:
        self.spark, self.path, self.prompt = spark, path.rstrip("/"), prompt

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch LONG").parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch LONG")

    def update(self, df: DataFrame, batch: int) -> None:
        """For ``foreachBatch`` or a loop: takes in the rows of a batch."""
        groups = df.groupBy(F.col(self.prompt).cast("string").alias("prompt")).agg(F.count(F.lit(1)).alias("n"))
        seen = self._read("seen", "prompt STRING").filter(F.col("batch") < batch).select(F.col("prompt").alias("p"))
        new = groups.join(seen, F.col("prompt").eqNullSafe(F.col("p")), "left_anti").select("prompt")
        new.write.mode("overwrite").parquet(f"{self.path}/seen/batch={batch}")
        count = self.spark.read.schema("prompt STRING").parquet(f"{self.path}/seen/batch={batch}").agg(F.count(F.lit(1)).alias("new_prompts"))
        stats = groups.agg(F.avg("n").alias("mean_size"), F.count(F.lit(1)).alias("prompts"), F.hll_sketch_agg("prompt", 14).alias("sketch"))
        stats.crossJoin(F.broadcast(count)).write.mode("overwrite").parquet(f"{self.path}/stats/batch={batch}")  # one row each

    def report(self) -> DataFrame:
        """(batch, mean_size, prompts, new_prompts, ever, about_ever): the last is the sketches' estimate of ``ever``."""
        stats = self._read("stats", "mean_size DOUBLE, prompts LONG, sketch BINARY, new_prompts LONG")
        so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
        about = F.hll_sketch_estimate(F.hll_union_agg("sketch").over(so_far))
        return stats.select("batch", "mean_size", "prompts", "new_prompts", F.sum("new_prompts").over(so_far).alias("ever"), about.alias("about_ever"))
