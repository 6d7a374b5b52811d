"""Whole evaluations: from responses to scores to tables, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import match, parse, text
from . import aggregate, joins, report


def score_samples(samples: DataFrame, responses: DataFrame, key: str = "id", amp: float = 1.0, compat_drop: bool = False) -> DataFrame:
    """Samples with quality, gned score and recognised text of their responses.

    A sample without a response keeps its row, with null scores and an error;
    ``compat_drop`` leaves such rows out.
    """
    d = joins.lookup_join(samples, responses.select(key, "response"), key, "null")
    d = d.withColumn("s", parse.score(F.col("response"), F.col("target"), amp))
    missing = F.col("response").isNull()
    out = d.select(
        *samples.columns, F.when(~missing, F.col("s.quality")).alias("qua"), F.when(~missing, F.col("s.semantic")).alias("gned"), F.when(~missing, F.col("s.recognised")).alias("recognised"),
        F.when(missing, F.lit("no response")).alias("error"),
    )
    return out.filter("error IS NULL").drop("error") if compat_drop else out


def classified(samples: DataFrame, target: str = "target", recognised: str = "recognised") -> DataFrame:
    """Adds correct, duplicate, irrelevant, typo and missing tokens, ideographs and words apart."""
    from ..functions import assign

    words = lambda c: text.tokens(F.filter(text.lower_split(F.col(c)), lambda w: w != ""))
    zh = lambda a: F.filter(a, lambda w: w.rlike(f"[{text.CJK}]"))
    other = lambda a: F.filter(a, lambda w: ~w.rlike(f"[{text.CJK}]"))
    d = samples.withColumn("__g", words(target)).withColumn("__p", words(recognised))
    d = d.withColumn("__zh", match.bag_classify(zh(F.col("__g")), zh(F.col("__p")))).withColumn("__en", match.bag_classify(other(F.col("__g")), other(F.col("__p"))))
    d = d.withColumn("__t", assign.typo_pairs("__en.irrelevant", "__en.missing"))
    both = lambda k, en: F.array_join(F.concat(F.col(f"__zh.{k}"), F.col(en)), " ").alias(f"{k}_text")
    return d.select(
        *samples.columns, both("correct", "__en.correct"), both("duplicate", "__en.duplicate"), both("irrelevant", "__t.irrelevant"), F.array_join("__t.typo", " ").alias("typo_text"), both("missing", "__t.missing")
    )


def board(scored: DataFrame, dataset: str, model: str, metrics: list[str], order: list[str]) -> dict[str, DataFrame]:
    """For each metric a table of models by data sets, and ``OVERALL``, the mean of the rounded cells."""
    cells = aggregate.mean_or_zero(scored, [dataset, model], metrics)
    overall = aggregate.macro_mean(cells, [model], metrics)
    return {m: report.pivot_table(cells, model, dataset, m, order).join(overall.select(model, F.col(m).alias("OVERALL")), model) for m in metrics}


def converted(inference: DataFrame) -> DataFrame:
    """Inference rows (id, data_source, response, labels) with the recognised texts of response and label."""
    read = lambda c: F.coalesce(parse.score_levels(F.col(c), F.lit(None).cast("string"), reference_free=True)["recognised"], F.lit(""))
    return inference.select(F.col("id").alias("image"), "id", F.coalesce("data_source", F.lit("")).alias("data_source"), read("response").alias("pred_text"), read("labels").alias("gt_text"))


def anomaly_board(rows: DataFrame, with_total: bool = True) -> DataFrame:
    """Anomaly detection and token recognition by language, level and category; rows of unknown sources are left out.

    The level comes from the id and the category from the source; where they
    disagree a row counts under its own pair (see ``mismatches``).
    """
    d = _keyed(rows)
    words = lambda c: text.anomaly_tokens(F.split(F.col(c), " ", -1))
    every = d if not with_total else d.withColumn("category", F.explode(F.array("category", F.lit("total"))))
    return aggregate.anomaly_metrics(every, ["lang", "level", "category"], tokens=words("gt_text"), pred_tokens=words("pred_text"))


def mismatches(rows: DataFrame) -> DataFrame:
    """Rows by (level, category) whose category names the other level."""
    d = _keyed(rows)
    return d.filter(~F.col("category").endswith(F.col("level"))).groupBy("level", "category").agg(F.count(F.lit(1)).alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    d = rows.withColumn("category", text.lookup(F.col("data_source"), text.SOURCE_CATEGORY)).filter(F.col("category").isNotNull())
    return d.withColumn("lang", F.when(text.contains_chinese(F.col("gt_text")), "zh").otherwise("en")).withColumn("level", text.level_of_id(F.col("id")))
