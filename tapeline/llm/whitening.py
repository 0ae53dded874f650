"""Whitening of embeddings: entries on an integer grid, their covariance in one aggregation, projections of unit variance.

The covariance is one Spark aggregation of generated expressions, a sum of centred products for each pair of dimensions
of the upper triangle. What reaches the driver is one row of d * (d + 1) / 2 sums, however many vectors there are; LAPACK
decomposes the matrix that they fill. A vector that occurs often is fitted once: equal grid vectors are combined before and
after the only shuffle of vectors, so a vector held by a third of all rows is a row a task there. The fit list is kept in the shared
checkpoint folder, as three aggregations read it: sums, centred products, and the covariance of what was whitened.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, ready
from .vectors import finite, matrix

WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_EXACT = float(1 << 62)


def pair_sums(names: list[str]) -> list[str]:
    """SQL sums of the products of every two columns, each pair once: the upper triangle, row by row."""
    return [f"sum({a} * {b}) as {a}_{b}" for i, a in enumerate(names) for b in names[i:]]


def symmetric(upper: list[float], d: int) -> np.ndarray:
    """The matrix of an upper triangle given row by row."""
    full = np.zeros((d, d))
    full[np.triu_indices(d)] = upper
    return full + np.triu(full, 1).T


def covariance(rows: DataFrame, centred: list[Column], n: int) -> np.ndarray:
    """The covariance of columns that are centred already, by one aggregation."""
    names = [f"c{i}" for i in range(len(centred))]
    # the columns are a step of their own, so that each is centred once and not for each of its pairs; none is null, and
    # Spark is told so, which spares every sum its checks
    flat = rows.select(*[F.coalesce(c, F.lit(0.0)).alias(name) for c, name in zip(centred, names, strict=True)])
    return symmetric(list(flat.selectExpr(*pair_sums(names)).first()), len(names)) / n


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Of a vector and its opposite the one is taken whose entry of largest magnitude is positive, so that reruns agree.
    """
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    return e, w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])


def _project(n: int, sums: np.ndarray, axes: np.ndarray, dead: np.ndarray):
    """Adds each vector's squared deviation, times n squared and exact, and its coordinates; null where there is no variance."""

    def apply(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column("x")]), np.int64)
            if not len(x):
                continue
            if n * float(np.abs(x).max()) < _EXACT and n * np.abs(x - sums / n).max() < (_EXACT / x.shape[1]) ** 0.5:
                off = n * x - sums
                far = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38))
            else:  # Python's integers have no bound
                off = n * x.astype(object) - sums.astype(object)
                far = pa.array([Decimal(int(k)) for k in (off * off).sum(axis=1)], pa.decimal128(38))
            w = (off.astype(np.float64) / n) @ axes
            flat = pa.array(w.ravel(), mask=np.broadcast_to(dead, w.shape).ravel())
            starts = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), far, pa.ListArray.from_arrays(starts, flat)], ["vec_id", "deviation", "w"])

    return apply


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each vector its coordinates on the first
    ``most`` principal components, each of variance 1 over the fit list.

    Each entry c counts as x = floor(scale * c) + shift. The fit list is each distinct x vector once, n in all, with sums S.
    deviation is the exact sum over dimensions of (n * x - S)^2; whitened is x - S / n projected on the unit eigenvector of
    the component, over the root of its eigenvalue; explained is the eigenvalue's share of the trace; identity_error is the largest
    absolute entry of whitened's covariance less the identity, measured over the fit list.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those of another length than the
    most frequent one (the longer of two). Repeated rows and ids give a row each, a null vec_id stays null. Components without
    variance (one vector, or fewer dimensions than components that vary) have null whitened and count for no identity_error,
    which is null if there are no others; explained is null where nothing varies. Empty table: no rows. Other columns are ignored.
    """
    spark = ready(vectors)
    rows = pick(vectors, vec_id="vec_id", embedding="embedding").where(finite(F.col("embedding")) & (F.size("embedding") > 0))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], WHITENED)
    d = length["d"]
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift))
    rows = rows.where(F.size("embedding") == d).select(F.col("vec_id").cast("long"), x.alias("x"))
    fit = cut(rows.groupBy("x").agg(F.lit(None).cast("long").alias("vec_id")))

    n, *sums = fit.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(d)]).first()
    v = covariance(fit, [(F.col("x")[i] * n - F.lit(s)) / n for i, s in enumerate(sums)], n)
    e, axes = components(v, most)
    k, trace = len(e), float(np.trace(v))
    dead = e <= e[0] * d * np.finfo(float).eps
    project = _project(n, np.array(sums), axes / np.sqrt(np.where(dead, 1.0, e)), dead)
    shape = "vec_id long, deviation decimal(38,0), w array<double>"

    alive = [i for i in range(k) if not dead[i]]
    error = None
    if alive:
        white = covariance(fit.select("vec_id", "x").mapInArrow(project, shape), [F.col("w")[i] for i in alive], n)
        error = float(np.abs(white - np.eye(len(alive))).max())
    share = F.lit([float(max(a, 0.0)) / trace if trace > 0 else None for a in e]).cast("array<double>")
    found = rows.mapInArrow(project, shape).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
