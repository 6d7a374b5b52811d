"""Leaderboards and grouped metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match

# Attributes of each group of an instruction-following benchmark.
BASIC = {
    "Attribute": ["shape+color", "color+texture", "texture+color", "shape+texture"],
    "Relation": ["2d_spatial_relation", "3d_spatial_relation", "action+2d", "action+3d"],
    "Reasoning": ["numeracy", "negation", "differentiation", "comparison"],
}
ADVANCED = {
    "Attribute+Relation": ["action+color", "action+texture", "color+2d", "color+3d", "shape+2d", "shape+3d", "texture+2d", "texture+3d"],
    "Attribute+Reasoning": ["numeracy+color", "numeracy+texture", "comparison+color", "comparison+texture", "differentiation+color", "differentiation+texture", "negation+color", "negation+texture"],
    "Relation+Reasoning": ["numeracy+2d", "numeracy+3d", "comparison+2d", "comparison+3d", "differentiation+2d", "differentiation+3d", "negation+2d", "negation+3d"],
    "Text Generation": ["text"],
    "Style Control": ["style"],
}
REAL_WORLD = {"Complex": ["real_world"]}


def attribute_groups() -> dict[str, list[str]]:
    out = {}
    for name, groups in (("Basic", BASIC), ("Advanced", ADVANCED), ("Real_World", REAL_WORLD)):
        out[f"{name}_Following_Overall"] = [a for g in groups.values() for a in g]
        prefix = "Real" if name == "Real_World" else name
        out |= {f"{prefix}_{k}": v for k, v in groups.items()}
    return out


def mean_or_zero(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means of the known values, 0 for none, and the number of rows."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def macro_mean(board: DataFrame, keys: list[str], metrics: list[str], round_first: bool = True, digits: int = 3) -> DataFrame:
    """Mean over a leaderboard's cells, of rounded cells by default."""
    cell = lambda m: F.bround(F.col(m), digits) if round_first else F.col(m)
    return board.groupBy(*keys).agg(*[F.avg(cell(m)).alias(m) for m in metrics])


def confusion(df: DataFrame, keys: list[str], gt: Column, pred: Column) -> DataFrame:
    """TP, FP, FN and TN of two conditions by keys, and over all last-key values as ``total``."""
    one = lambda c, name: F.count_if(c).alias(name)
    last = keys[-1]
    out = df.rollup(*keys) if len(keys) == 1 else df.groupingSets([keys, keys[:-1]], *keys)
    out = out.agg(one(gt & pred, "tp"), one(~gt & pred, "fp"), one(gt & ~pred, "fn"), one(~gt & ~pred, "tn"), F.grouping(last).alias("__t"))
    return out.withColumn(last, F.when(F.col("__t") == 1, F.lit("total")).otherwise(F.col(last).cast("string"))).drop("__t")


def ratios(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of counts; 0 where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    d = df.withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def micro_levels(counts: DataFrame, fixed: list[str], over: list[str], all_name: str = "all") -> DataFrame:
    """Counters tp, fp, fn, tn, hits, tokens and edit summed at every level over some keys, and the ratios derived from the sums of each level.

    A key that is summed over reads ``all_name``. One pass: partial sums of all
    levels leave a task together. Cells that a level doesn't have count nothing;
    null counters count 0.
    """
    counters = ("tp", "fp", "fn", "tn", "hits", "tokens", "edit")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    levels = [[*fixed, *(k for i, k in enumerate(over) if which >> i & 1)] for which in range(1 << len(over))]
    out = counts.groupingSets(levels, *fixed, *over).agg(*sums, *[F.grouping(k).alias(f"__{k}") for k in over])
    out = out.withColumns({k: F.when(F.col(f"__{k}") == 1, F.lit(all_name)).otherwise(F.col(k).cast("string")) for k in over}).drop(*[f"__{k}" for k in over])
    return _token_ratios(ratios(out))


def _token_ratios(df: DataFrame) -> DataFrame:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return df.withColumn("token_recall", over("hits", "tokens")).withColumn("token_ned", over("edit", "tokens"))


def anomaly_metrics(df: DataFrame, keys: list[str], pred: str = "pred_text", gt: str = "gt_text", tokens: Column | None = None, pred_tokens: Column | None = None) -> DataFrame:
    """Anomaly confusion by rows and token recognition by tokens, summed in each row first: one aggregation, no token moves."""
    kind = match.anomaly_confusion(match.count_marks(F.col(pred)), match.count_marks(F.col(gt)))
    t = match.token_hits(tokens, pred_tokens)
    d = df.select(*keys, kind.alias("__kind"), t.alias("__t"))
    by = [F.count_if(F.col("__kind") == k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")]
    out = d.groupBy(*keys).agg(*by, F.sum("__t.hits").alias("hits"), F.sum("__t.tokens").alias("tokens"), F.sum("__t.edit").alias("edit"))
    return _token_ratios(ratios(out))


def text_score(df: DataFrame, keys: list[str], distance: str, matched: str, total: str, most: float = 100.0) -> DataFrame:
    """Mean distance, completion rate, word accuracy and the composite text score (``most``: 100 for English, 50 for Chinese)."""
    out = df.groupBy(*keys).agg(
        F.avg(F.col(distance).cast("double")).alias("ed"),
        F.avg((F.col(distance) == 0).cast("double")).alias("cr"),
        F.try_divide(F.sum(matched), F.sum(total)).alias("wac"),
    )
    return out.withColumn("text_score", 1 - F.least(F.lit(float(most)), F.col("ed")) * (1 - F.col("cr")) * (1 - F.col("wac")) / most)


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Sum of value times weight over the sum of weights, which counts 1 at least."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(value), F.sum(weight).alias(weight))


def group_means(df: DataFrame, keys: list[str], attribute: str, value: str, groups: dict[str, list[str]]) -> DataFrame:
    """Means by named groups of attributes; an attribute may be in several."""
    spark = df.sparkSession
    bridge = spark.createDataFrame([(g, a) for g, attrs in groups.items() for a in attrs], f"grp string, `{attribute}` string")
    return df.join(F.broadcast(bridge), attribute).groupBy(*keys, "grp").agg(F.avg(value).alias(value))


def two_level_mean(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over items of the mean within an item."""
    return df.groupBy(*inner).agg(F.avg(value).alias(value)).groupBy(*outer).agg(F.avg(value).alias(value))


def dependency_filtered(scores: DataFrame, parents: DataFrame) -> DataFrame:
    """(item, question, score): a question counts 0 where one of its direct parents scored 0; parent 0 is the root."""
    p = parents.filter("parent <> 0").join(scores.select(F.col("item"), F.col("question").alias("parent"), F.col("score").alias("ps")), "parent")
    failed = p.groupBy("item", "question").agg(F.bool_or(F.col("ps") == 0).alias("failed"))
    out = scores.join(failed, ["item", "question"], "left")
    return out.select("item", "question", F.when(F.coalesce("failed", F.lit(False)), 0).otherwise(F.col("score")).alias("score"))


def mark_best(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Adds is_best: the largest value of its metric. Aggregated first, so no metric's rows meet in one task."""
    best = df.groupBy(metric).agg(F.max(value).alias("__best"))
    return df.join(best, metric).withColumn("is_best", F.col(value) == F.col("__best")).drop("__best")


def length_profile(df: DataFrame, length: str, short: int, long: int) -> DataFrame:
    """Counts and shares by length class, with extremes, mean and median over all."""
    n = F.col(length)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n < short).alias("short"), F.count_if((n >= short) & (n < long)).alias("middle"), F.count_if(n >= long).alias("long"),
        F.min(n).alias("lo"), F.max(n).alias("hi"), F.avg(n).alias("mean"), F.median(n).alias("median"),
    )


def board_name(model: Column, path: Column, english_only: list[str]) -> Column:
    """Models scored on data sets that exist in English alone (found by name in the path) are marked so."""
    of_one = reduce(lambda a, b: a | b, [path.contains(x) for x in english_only], F.lit(False))
    return F.when(of_one, F.concat(model, F.lit("_EN"))).otherwise(model)


def regroup(counts: DataFrame, keys: list[str], category: str, table: dict[str, str], out: str = "grp") -> DataFrame:
    """Counters summed over the categories of a group, and ratios derived from the sums; unknown categories are left out."""
    from ..functions.text import lookup

    d = counts.withColumn(out, lookup(F.col(category), table)).filter(F.col(out).isNotNull())
    return ratios(d.groupBy(*keys, out).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def wide_mean(df: DataFrame, columns: list[str], out: str = "mean") -> DataFrame:
    """Mean over columns of a row, NaN and null left out; null where all are."""
    known = F.filter(F.array(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns]), lambda x: x.isNotNull())
    return df.withColumn(out, F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(known), F.lit(0))))


def accuracy(df: DataFrame, keys: list[str], right: str) -> DataFrame:
    """Share of right answers in lists of booleans, null where there are no questions."""
    hits = F.size(F.filter(right, lambda x: x))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(hits), F.sum(F.size(right))).alias("accuracy"))


def style_scores(images: DataFrame, refs: DataFrame, style: str, encoders: list[str]) -> DataFrame:
    """Adds style_score: the mean over encoders of the largest cosine with the style's reference vectors, at least 0.

    ``refs`` has a bounded number of vectors a style; images of unknown style are left out.
    """
    from ..functions import vec

    r = refs.groupBy(style).agg(*[F.collect_list(e).alias(f"__{e}") for e in encoders])
    nearest = lambda e: F.array_max(F.transform(f"__{e}", lambda v: F.greatest(vec.cosine(F.col(e), v), F.lit(0.0))))
    best = [nearest(e) for e in encoders]
    d = images.filter(F.col(style).isNotNull()).join(r, style)
    return d.withColumn("style_score", vec.mean_known(F.array(*best))).drop(*[f"__{e}" for e in encoders])


def success(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.avg(ok.cast("double")).alias("rate"))


def concat_lists(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Lists of batches as one list, in the order of the batches."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__l")).select(*keys, F.flatten(F.col(f"__l.{value}")).alias(value))


def logged_means(df: DataFrame, prefix: str = "reward_", leave_out: str = "_accuracy") -> DataFrame:
    """One row with the mean of every reward column but those that end in ``_accuracy``."""
    names = [c for c in df.columns if c.startswith(prefix) and not c.endswith(leave_out)]
    return df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in names])


def every_nth_positive_mean(df: DataFrame, keys: list[str], frame: str, value: str, n: int = 4) -> DataFrame:
    """Video reward: the mean of the positive rewards of every n-th frame, 0 where there is none."""
    counts = (F.col(frame) % n == 0) & (F.col(value) > 0)
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(counts, F.col(value))), F.lit(0.0)).alias(value))


def first_occurrences(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The different values of a key in the order of their first rows, one row each: (keys, value, place)."""
    from .scan import with_places

    first = df.groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return with_places(first, keys, ["__first", value], "place").select(*keys, F.col(value), "place")


def match_ratio(df: DataFrame, keys: list[str], gt: str, recognised: str) -> DataFrame:
    """Matched and expected tokens and their ratio, characters where the target holds ideographs, else words; 0 without targets."""
    m = match.match_counts(F.col(gt), F.col(recognised))
    d = df.select(*keys, m.alias("m")).groupBy(*keys).agg(F.sum("m.matched").alias("matched"), F.sum("m.expected").alias("expected"))
    return d.withColumn("ratio", F.coalesce(F.try_divide("matched", "expected"), F.lit(0.0)))
