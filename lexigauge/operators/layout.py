"""Layouts of text regions in the unit square: fixed tables, random ones, and a checker of constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import joins, sample

# Regions (m_offset, n_offset, m_scale, n_scale) for 1 to 5 texts.
FIXED = {
    1: [(0.1, 0.2, 0.8, 0.6)],
    2: [(0.1, 0.1, 0.8, 0.35), (0.1, 0.55, 0.8, 0.35)],
    3: [(0.1, 0.1, 0.8, 0.2), (0.1, 0.4, 0.8, 0.2), (0.1, 0.7, 0.8, 0.2)],
    4: [(0.1, 0.1, 0.8, 0.125), (0.1, 0.325, 0.8, 0.125), (0.1, 0.55, 0.8, 0.125), (0.1, 0.775, 0.8, 0.125)],
    5: [(0.1, 0.1, 0.8, 0.2), (0.1, 0.4, 0.35, 0.2), (0.55, 0.4, 0.35, 0.2), (0.1, 0.7, 0.35, 0.2), (0.55, 0.7, 0.35, 0.2)],
}
SCHEMA = "area int, pos int, m_offset double, n_offset double, m_scale double, n_scale double"


def fixed_layouts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, i, *r) for a, rs in FIXED.items() for i, r in enumerate(rs)], SCHEMA)


def random_region(seed: Column, salt: int = 0) -> Column:
    """A region inside the unit square, at least a tenth wide and high, by hash."""
    u = lambda i: sample.draw(seed, 4 * salt + i) / float(1 << 32)
    m, n = u(0) * 0.9, u(1) * 0.9
    return F.struct(m.alias("m_offset"), n.alias("n_offset"), (0.1 + u(2) * (0.9 - m)).alias("m_scale"), (0.1 + u(3) * (0.9 - n)).alias("n_scale"))


def region_ok(min_area: float, low: float = 1.5, high: float = 2.5, slack: float = 0.0) -> Column:
    """Inside the square, large enough, within the aspect ratios; up to ``slack``."""
    m, n, w, h = (F.col(c) for c in ("m_offset", "n_offset", "m_scale", "n_scale"))
    return (m >= -slack) & (n >= -slack) & (m + w <= 1 + slack) & (n + h <= 1 + slack) & (w * h >= min_area - slack) & (w >= low * h - slack) & (w <= high * h + slack)


def overlaps(regions: DataFrame, layout: str = "area", pos: str = "pos") -> DataFrame:
    """Pairs of regions of one layout that overlap; a layout has a handful of regions."""
    p = joins.pairs_within(regions, layout, pos)
    apart = (F.col("m_offset_1") + F.col("m_scale_1") <= F.col("m_offset_2")) | (F.col("m_offset_2") + F.col("m_scale_2") <= F.col("m_offset_1")) | (F.col("n_offset_1") + F.col("n_scale_1") <= F.col("n_offset_2")) | (F.col("n_offset_2") + F.col("n_scale_2") <= F.col("n_offset_1"))
    return p.filter(~apart).select(layout, f"{pos}_1", f"{pos}_2")
