"""Grouped rewards: advantages, masks, pairs, loss statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sample


def with_group_stats(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds __mean and __std (population) of the row's group. Aggregated with partial sums and joined, so large groups are no single task."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__std"))
    return df.join(stats, group)


def grpo_advantage(df: DataFrame, group: str, reward: str, global_std: bool = False, eps: float = 1e-4) -> DataFrame:
    """(reward - group mean) / (std + eps); the std is the group's, or that of all rows."""
    out = with_group_stats(df, group, reward)
    if global_std:
        out = out.drop("__std").crossJoin(F.broadcast(df.agg(F.stddev_pop(reward).alias("__std"))))  # one row
    return out.withColumn("advantage", (F.col(reward) - F.col("__mean")) / (F.col("__std") + eps)).drop("__mean", "__std")


def global_advantage(df: DataFrame, reward: str, eps: float = 1e-4) -> DataFrame:
    stats = df.agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__std"))
    return df.crossJoin(F.broadcast(stats)).withColumn("advantage", (F.col(reward) - F.col("__mean")) / (F.col("__std") + eps)).drop("__mean", "__std")


def best_of_group(df: DataFrame, group: str, reward: str) -> DataFrame:
    """1 for each row that equals its group's maximum, else 0."""
    top = df.groupBy(group).agg(F.max(reward).alias("__top"))
    return df.join(top, group).withColumn("advantage", (F.col(reward) == F.col("__top")).cast("double")).drop("__top")


def dpo_pair(df: DataFrame, group: str, reward: str, pos: str) -> DataFrame:
    """+1 for the first maximum, -1 for the first minimum, else 0. Equal rewards: -1 and +1 for the first two; alone: 0."""
    stats = df.groupBy(group).agg(
        F.max(F.struct(F.col(reward), (-F.col(pos)).alias("p"))).alias("__hi"),
        F.min(F.struct(F.col(reward), F.col(pos).alias("p"))).alias("__lo"),
        F.min(pos).alias("__first"),
        F.count(F.lit(1)).alias("__n"),
    )
    d = df.join(stats, group)
    equal = F.col(f"__hi.{reward}") == F.col(f"__lo.{reward}")
    second = d.filter(F.col(pos) > F.col("__first")).groupBy(group).agg(F.min(pos).alias("__second"))
    d = d.join(second, group, "left")
    p = F.col(pos)
    tie = F.when(p == F.col("__first"), -1.0).when(p == F.col("__second"), 1.0).otherwise(0.0)
    usual = F.when(p == -F.col("__hi.p"), 1.0).when(p == F.col("__lo.p"), -1.0).otherwise(0.0)
    adv = F.when(F.col("__n") == 1, 0.0).when(equal, tie).otherwise(usual)
    return d.withColumn("advantage", adv).drop("__hi", "__lo", "__first", "__second", "__n")


def dpo_pairs(df: DataFrame, group: str, reward: str, pos: str) -> DataFrame:
    """(group, winner, loser) positions of each group that has both."""
    d = dpo_pair(df, group, reward, pos).filter("advantage <> 0")
    return d.groupBy(group).agg(F.max_by(pos, "advantage").alias("winner"), F.min_by(pos, "advantage").alias("loser")).filter("winner <> loser")


def pad_groups(df: DataFrame, group: str, workers: int, seed: int = 0) -> DataFrame:
    """Repeats some groups, drawn by hash, so their number is a multiple of the workers."""
    n = df.count()
    lack = -n % workers
    return df if not lack else df.unionByName(df.orderBy(F.xxhash64(F.col(group), F.lit(seed)), group).limit(lack))


def zero_std(df: DataFrame, group: str, reward: str) -> DataFrame:
    """One row: share of groups whose rewards are all equal, mean of the groups' std, mean size, number of groups."""
    g = df.groupBy(group).agg(F.max(reward).alias("hi"), F.min(reward).alias("lo"), F.stddev_pop(reward).alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.avg((F.col("hi") == F.col("lo")).cast("double")).alias("zero_ratio"), F.avg("sd").alias("mean_std"), F.avg("n").alias("mean_size"), F.count(F.lit(1)).alias("groups"))


def nonzero_mask(advantages: Column) -> Column:
    """Whether any step of an advantage list isn't 0."""
    return F.aggregate(advantages, F.lit(0.0), lambda s, x: s + F.abs(x)) != 0


def masked(df: DataFrame, mask: str, batches: int, key: str, seed: int = 0, refill_when_empty: bool = True) -> DataFrame:
    """Rows with signal, and as many of the others, drawn by hash, as fill the last batch, where there are enough."""
    counts = df.agg(F.count_if(F.col(mask)).alias("k"), F.count_if(~F.col(mask)).alias("z")).first()
    lack = batches - counts.k % batches if counts.k % batches or (counts.k == 0 and refill_when_empty) else 0
    kept = df.filter(mask)
    if not lack or counts.z < lack:
        return kept
    return kept.unionByName(df.filter(~F.col(mask)).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(lack))


def nudged(df: DataFrame, advantages: str, eps: float = 1e-6) -> DataFrame:
    """Adds eps to every step's advantage where no row of the whole batch has any signal."""
    any_signal = df.agg(F.coalesce(F.bool_or(nonzero_mask(F.col(advantages))), F.lit(True)).alias("__any"))
    d = df.crossJoin(F.broadcast(any_signal))  # one row
    return d.withColumn(advantages, F.when(F.col("__any"), F.col(advantages)).otherwise(F.transform(advantages, lambda x: x + eps))).drop("__any")


def over_steps(reward: Column, steps: int | Column, kl: Column | None = None, coef: float = 0.0) -> Column:
    """A reward for each step, less a penalty for divergence."""
    return F.array_repeat(reward, steps) if kl is None else F.transform(kl, lambda k: reward - coef * k)


def known_mean(value: str, sentinel: float = -10) -> Column:
    return F.avg(F.when(F.col(value) != sentinel, F.col(value)))


def policy_stats(df: DataFrame, eps_low: float, eps_high: float | None = None, clip: float = 5.0, guard: bool = False, dt: str | None = None) -> DataFrame:
    """One row of loss statistics over (advantage, log_prob, old_log_prob) rows; with two sides of clipping.

    ``guard`` adds the ratio's mean and sample std; ``dt`` names a column of step sizes that losses are divided by.
    """
    hi = eps_low if eps_high is None else eps_high
    diff = F.col("log_prob") - F.col("old_log_prob")
    ratio, adv = F.exp(diff), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("advantage")))
    clipped = F.greatest(F.lit(1 - eps_low), F.least(F.lit(1 + hi), ratio))
    share = lambda c: F.avg(c.cast("double"))
    out = [
        (0.5 * F.avg(diff * diff)).alias("approx_kl"),
        share((ratio - 1 > hi) | (1 - ratio > eps_low)).alias("clipfrac"),
        share(ratio - 1 > hi).alias("clipfrac_gt_one"),
        share(1 - ratio > eps_low).alias("clipfrac_lt_one"),
        F.avg(F.greatest(-adv * ratio, -adv * clipped) / (F.lit(1.0) if dt is None else F.col(dt))).alias("policy_loss"),
    ]
    if guard:
        out += [F.avg(ratio).alias("ratio_mean"), F.stddev_samp(ratio).alias("ratio_std")]
    return df.agg(*out)


def dpo_loss(w: Column, w_ref: Column, l: Column, l_ref: Column, beta: float) -> Column:  # noqa: E741
    """-log sigmoid(-beta/2 ((w - w_ref) - (l - l_ref))), in the form that doesn't overflow."""
    x = -0.5 * beta * ((w - w_ref) - (l - l_ref))
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ema(values: Column, decay: float, every: int = 1) -> Column:
    """Moving average of a list with warm-up decay, updated every k steps."""
    steps = F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        d = F.least((1 + x["i"]) / (10 + x["i"]), F.lit(decay))
        return F.when((x["i"] + 1) % every == 0, acc + (1 - d) * (x["v"] - acc)).otherwise(acc)

    return F.aggregate(steps, F.element_at(values, 1).cast("double"), step)


def shards(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Contiguous near-equal shards, the first ones larger."""
    return sample.dealt(df, n, "shard", *order)


def raw_advantage(df: DataFrame, reward: str) -> DataFrame:
    """Reward-weighted regression takes the reward itself."""
    return df.withColumn("advantage", F.col(reward))
