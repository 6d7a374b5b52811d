"""Embedding whitening by hierarchical merging of singular value decompositions.

Each vector c becomes whole numbers x = floor(256 * c). The model is fitted to
each distinct x once. A partition turns its rows into a summary: their number,
exact sums, mean, and the singular values times the right singular vectors of
the centred rows, as many as there are dimensions (nothing is truncated). Two
summaries merge by stacking both and one row sqrt(n1 n2 / (n1 + n2)) (m1 - m2)
that accounts for the different means, and decomposing again, so the merged
summary has exactly the scatter of all rows. Within a task, batches merge one by
one; across tasks, ``FAN`` summaries merge into one, round by round, in tasks of
their own. A summary is dims x dims doubles, whatever the number of rows, and one
of them reaches the driver. No scatter matrix is formed, so small components keep
their precision.

``whiten`` projects x - S / n on the leading components over the square roots of
their eigenvalues. ``identity_error`` says how far the covariance of all whitened
components, over the fit list, is from the identity.

Rows whose vector is null or holds a null or non-finite entry are left out, and so
are those whose length isn't the commonest one (of equally common ones, the
largest); empty vectors have no length. An x beyond 64 bits becomes the nearest
number of 64 bits. A null id stays; repeated rows and equal vectors are each
projected. Where an eigenvalue is zero to double precision (one vector, or fewer
than dimensions) its whitened values are null, and so is ``explained`` without any
variance, ``identity_error`` without any component, and a deviation of more than 64 bits.
No rows give an empty table. Other columns aren't looked at.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise

SCALE, COMPONENTS, FAN, BLOCK = 256, 4, 16, 4096
SUMMARY = "n long, sums array<decimal(38,0)>, mean array<double>, svd array<double>"


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    axes: np.ndarray  # a component in each row


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is known and finite, all of one length."""
    fine = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.coalesce(fine, F.lit(False)))
    common = d.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return d.filter(F.size("v") == (common.dims if common else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summarise(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, exact sums, mean, singular values times right singular vectors) of rows of whole numbers."""
    sums = x.astype(object).sum(axis=0) if len(x) * np.abs(x.astype(float)).max() >= 2.0**62 else x.sum(axis=0).astype(object)
    mean = np.array([float(s) / len(x) for s in sums])
    return len(x), sums, mean, decompose(x - mean)


def decompose(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors, a square matrix; rows are reduced to a triangle first."""
    d = rows.shape[1]
    if len(rows) > d:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((d, d))
    out[: len(s)] = s[:, None] * v
    return out


def merge(a, b):
    n = a[0] + b[0]
    apart = np.sqrt(a[0] / n * b[0]) * (a[2] - b[2])
    return n, a[1] + b[1], a[2] + (b[2] - a[2]) * (b[0] / n), decompose(np.vstack([a[3], b[3], apart]))


def fit(x: DataFrame) -> Fit | None:
    """The model of the distinct rows of ``x`` (column x); None without rows."""

    def local(batches):
        have = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                one = summarise(_matrix(b.column(0).slice(at, BLOCK)))
                have = merge(have, one) if have else one
        if have:
            yield from pa.Table.from_pylist([{"n": have[0], "sums": [int(s) for s in have[1]], "mean": have[2].tolist(), "svd": have[3].ravel().tolist()}], schema=arrow).to_batches()

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        have = None
        for n, sums, mean, svd in part.sort_values("node")[["n", "sums", "mean", "svd"]].itertuples(index=False):
            one = int(n), np.array([int(s) for s in sums], object), np.array(mean), np.array(svd).reshape(len(mean), -1)
            have = merge(have, one) if have else one
        return pd.DataFrame({"n": [have[0]], "sums": [[Decimal(s) for s in have[1]]], "mean": [have[2]], "svd": [have[3].ravel()], "node": [part["node"].iloc[0] // FAN]})

    arrow = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("svd", pa.list_(pa.float64()))])
    parts = materialise(x.select("x").mapInArrow(local, SUMMARY).withColumn("node", F.spark_partition_id().cast("long")), "summaries")
    while (tasks := parts.agg(F.count(F.lit(1)), F.max("node")).first())[0] > 1:
        parts = materialise(parts.groupBy(F.floor(F.col("node") / FAN).alias("g")).applyInPandas(merged, f"{SUMMARY}, node long"), "summaries")
    if not tasks[0]:
        return None
    last = parts.first()
    _, s, v = np.linalg.svd(np.array(last.svd).reshape(len(last.mean), -1))
    s[s <= len(s) * np.finfo(float).eps * s[0]] = 0
    return Fit(last.n, [int(t) for t in last.sums], s**2 / last.n, v)


def project(model: Fit, x: np.ndarray, k: int) -> np.ndarray:
    """Whitened values of rows for the first k components; NaN where the eigenvalue is zero."""
    mean = np.array([float(s) / model.n for s in model.sums])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values[:k] > 0, (x - mean) @ model.axes[:k].T / np.sqrt(model.values[:k]), np.nan)


def deviations(model: Fit, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row; null where it has more than 64 bits."""
    most = np.abs(x.astype(float)).max() * model.n + max(map(abs, model.sums))
    if most < 2.0**62 and most * most * x.shape[1] < 2.0**63:
        return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    far = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
    return [int(d) if d < 2**63 else None for d in far]


def identity_error(x: DataFrame, model: Fit) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity; null without a component."""
    k = int((model.values > 0).sum())
    if not k:
        return None

    def local(batches):
        have = np.zeros((k + 1, k))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                z = project(model, _matrix(b.column(0).slice(at, BLOCK)), k)
                have += np.vstack([z.T @ z, z.sum(axis=0)])  # whitened values are centred but for rounding
        yield pa.RecordBatch.from_arrays([pa.array(range(have.size), pa.int32()), pa.array(have.ravel())], ["cell", "total"])

    cells = x.select("x").mapInArrow(local, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # dims x dims
    have = np.zeros((k + 1) * k)
    have[[c.cell for c in cells]] = [c.total for c in cells]
    have = have.reshape(k + 1, k) / model.n
    return float(np.abs(have[:k] - np.outer(have[k], have[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each known vector and leading component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(vectors, id_col, vector_col)
    distinct = materialise(rows.select("x").distinct(), "distinct")
    model = fit(distinct)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(distinct, model), min(components, len(model.values))
    trace = float(model.values.sum())
    explained = [float(e) / trace if trace else None for e in model.values[:k]]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x, m = _matrix(part.column(1)), part.num_rows
                z = project(model, x, k).ravel()
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(deviations(model, x), pa.int64()).take(each), pa.array(z, mask=np.isnan(z)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
