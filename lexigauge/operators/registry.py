"""Named rewards and composites of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match, parse, text, vec

REWARDS: dict[str, Callable[..., Column]] = {}


def reward(name: str):
    """Registers a function of columns that gives a reward, or a struct of components."""

    def add(f):
        REWARDS[name] = f
        return f

    return add


reward("ocr")(match.ocr_reward)
reward("quality")(match.quality)
reward("ned")(lambda target, rec: 1 - match.ned(target, rec))
reward("text")(lambda response, ref: parse.score(response, ref))
reward("clip")(vec.clip_score)
reward("cosine")(vec.cosine)
reward("pickscore")(lambda x: x / 26)
reward("clipscore")(lambda x: x / 30)
reward("grade")(lambda x: x / 5)
reward("vlm_grade")(text.score_tag)
reward("final_grade")(text.final_score)
reward("aesthetic")(vec.unit_aesthetic)
reward("jpeg_size")(lambda kb: -kb / 500)


def add_rewards(df: DataFrame, spec: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Adds reward_<name> for each name: (registered reward, input columns)."""
    return df.withColumns({f"reward_{n}": REWARDS[kind](*map(F.col, cols)) for n, (kind, cols) in spec.items()})


def composite(df: DataFrame, weights: dict, out: str = "reward_avg") -> DataFrame:
    """The weighted sum of rewards (it is a sum, whatever its name); nested weights take a struct's components."""
    return df.withColumn(out, vec.weighted(weights, lambda n: F.col(f"reward_{n}")))


def safe(score: Column, error: Column) -> Column:
    """0 for a row whose scoring failed; the row and its error stay."""
    return F.when(error.isNotNull(), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


# -- rewards by tag


def tag_rewards(df: DataFrame, tag: str, reward: str, strict: str, tags: list[str], sentinel: float = -10.0) -> DataFrame:
    """Adds ``rewards``, a map: accuracy and strict_accuracy of each row, and both for each tag, the sentinel but for the row's own tag.

    Every row has the same keys, so batches of different tags line up.
    """
    mine = lambda t, c: F.when(F.col(tag) == t, F.col(c)).otherwise(F.lit(sentinel))
    entries = [("accuracy", F.col(reward)), ("strict_accuracy", F.col(strict))]
    entries += [e for t in tags for e in ((f"{t}_accuracy", mine(t, reward)), (f"{t}_strict_accuracy", mine(t, strict)))]
    return df.withColumn("rewards", F.create_map(*[x for name, c in entries for x in (F.lit(name), c.cast("double"))]))


def map_means(df: DataFrame, keys: list[str], rewards: str = "rewards", sentinel: float = -10.0) -> DataFrame:
    """Means of map-typed rewards key by key, without the sentinel and nulls: (keys, name, mean, n).

    Entries are summed by name in each task before they move, so neither rows nor maps meet in one place.
    """
    d = df.select(*keys, F.explode(rewards).alias("name", "value")).filter(F.col("value").isNotNull() & (F.col("value") != sentinel))
    return d.groupBy(*keys, "name").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def as_map(means: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with the means as a map; there are as many entries as names."""
    return means.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "mean")))).alias("rewards"))


# -- metrics by name

#: A metric has a column for each row, and an aggregate of that column.
METRICS: dict[str, tuple[Callable[..., Column], Callable[[Column], Column]]] = {}


def metric(name: str, row: Callable[..., Column], fold: Callable[[Column], Column] = F.avg) -> None:
    METRICS[name] = row, fold


def _matched(gt: Column, rec: Column) -> Column:
    return F.struct(match.bag_overlap(gt, rec).alias("hits"), F.size(gt).alias("tokens"))


metric("ned", match.ned)
metric("completion", lambda gt, rec: (gt == rec).cast("double"))
metric("edit_distance", lambda gt, rec: F.levenshtein(gt, rec).cast("double"))
metric("quality", match.quality)
metric("ocr", match.ocr_reward)
metric("cosine", vec.cosine)
metric("mean", lambda x: x.cast("double"))
metric("worst", lambda x: x.cast("double"), F.min)
metric("word_accuracy", lambda gt, rec: _matched(F.split(gt, " "), F.split(rec, " ")), lambda s: F.try_divide(F.sum(s["hits"]), F.sum(s["tokens"])))
metric("char_accuracy", lambda gt, rec: _matched(text.characters(gt), text.characters(rec)), lambda s: F.try_divide(F.sum(s["hits"]), F.sum(s["tokens"])))
metric("anomaly_f1", lambda gt, rec: match.anomaly_confusion(match.count_marks(rec), match.count_marks(gt)), lambda k: F.try_divide(2 * F.count_if(k == "TP"), 2 * F.count_if(k == "TP") + F.count_if(k == "FP") + F.count_if(k == "FN")))


def evaluate(df: DataFrame, keys: list[str], asked: dict[str, tuple[str, list[str]]], unit: str | None = None) -> DataFrame:
    """Metrics asked for by name, {column: (metric, input columns)}, by keys; all of them from one scan and one aggregation.

    Only columns that a metric asked for needs are read. With ``unit``, a column
    says which of them a row counts for (a list of names), as a file that holds
    the rows of several benchmarks does; other rows count nothing there.
    """
    unknown = sorted({kind for kind, _ in asked.values()} - METRICS.keys())
    if unknown:
        raise ValueError(f"no metric {', '.join(unknown)}; there are {', '.join(sorted(METRICS))}")
    value = lambda name, kind, cols: METRICS[kind][0](*map(F.col, cols)) if unit is None else F.when(F.array_contains(unit, name), METRICS[kind][0](*map(F.col, cols)))
    d = df.select(*keys, *[value(n, kind, cols).alias(f"__{n}") for n, (kind, cols) in asked.items()])
    return d.groupBy(*keys).agg(*[METRICS[kind][1](F.col(f"__{n}")).alias(n) for n, (kind, _) in asked.items()])
