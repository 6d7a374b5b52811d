"""Vectors as arrays: products, norms, composites, step statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clip_score(a: Column, b: Column) -> Column:
    return 2.5 * F.greatest(cosine(a, b), F.lit(0.0))


def scaled_preference(a: Column, b: Column, logit_scale: Column | float, over: float = 26.0) -> Column:
    return logit_scale * cosine(a, b) / over


def mean_known(a: Column) -> Column:
    """Mean of the values that aren't null, null for none."""
    k = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, x: s + x.cast("double")), F.nullif(F.size(k), F.lit(0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def unit_aesthetic(x: Column) -> Column:
    """A grade of 1 to 10 on a scale of 0 to 1."""
    return (clamp(x, 1.0, 10.0) - 1) / 9


def weighted(weights: dict, value=lambda name: F.col(name)) -> Column:
    """Weighted sum of named rewards; a nested dict weighs the components of a struct."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if isinstance(w, dict):
            for part, x in w.items():
                total = total + x * value(name)[part]
        else:
            total = total + w * value(name)
    return total


#: Weight of quality, weight of semantics, amplification.
PRESETS = {"eval": (0.5, 0.5, 1.0), "amp5": (0.5, 0.5, 5.0), "default": (0.0, 1.0, 5.0)}


def composite(quality: Column, semantic: Column, preset: str = "eval") -> Column:
    q, s, _ = PRESETS[preset]
    return (q * quality + s * semantic) / (q + s)


def pooled(states: Column, mask: Column, how: str = "mean") -> Column:
    """One vector of a list of vectors and a 0/1 mask: mean, weighted_mean (later ones weigh more), or last."""
    rows = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    if how == "last":
        return F.element_at(rows, -1)["v"]
    n = F.size(rows)
    weight = (lambda i: (i + 1).cast("double")) if how == "weighted_mean" else (lambda i: F.lit(1.0))
    total = n * (n + 1) / 2 if how == "weighted_mean" else n
    first = F.transform(F.element_at(rows, 1)["v"], lambda x: F.lit(0.0))
    weighed = F.transform(rows, lambda r, i: F.transform(r["v"], lambda x: x.cast("double") * weight(i)))
    return F.transform(F.aggregate(weighed, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / total)


def step_log_prob(sample: Column, output: Column, previous: Column, sigma: Column, sigma_prev: Column, sigma_max: Column, noise: float = 0.7, kind: str = "sde") -> Column:
    """struct(mean, log_prob) of one denoising step; the log-probability is the mean over the vector."""
    dt = sigma_prev - sigma
    if kind == "sde":
        std = F.sqrt(sigma / (1 - F.when(sigma == 1, sigma_max).otherwise(sigma))) * noise
        mean = F.zip_with(sample, output, lambda x, m: x * (1 + std**2 / (2 * sigma) * dt) + m * (1 + std**2 * (1 - sigma) / (2 * sigma)) * dt)
        spread = std * F.sqrt(-dt)
        log_p = lambda d: -(d**2) / (2 * spread**2) - F.log(spread) - math.log(math.sqrt(2 * math.pi))
    else:
        std = sigma_prev * math.sin(noise * math.pi / 2)
        mean = F.zip_with(sample, output, lambda x, m: (x - sigma * m) * (1 - sigma_prev) + (x + m * (1 - sigma)) * F.sqrt(sigma_prev**2 - std**2))
        log_p = lambda d: -(d**2)
    return F.struct(mean.alias("mean"), mean_known(F.zip_with(previous, mean, lambda p, m: log_p(p - m))).alias("log_prob"))


def pad_to(a: Column, n: Column, value: float = 0.0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def all_zero(a: Column) -> Column:
    """Whether every value is 0, as in a black image; true for none."""
    return ~F.exists(a, lambda x: x != 0)
