"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers (floor of 256 times the entry), so equal vectors, counts, sums and deviations are exact. The components are fitted on the distinct vectors: Spark MLlib's
``computeSVD`` decomposes the distributed matrix of centred rows, and singular values over the root of n are the standard deviations along its right singular vectors. The total variance is summed
separately from the exact deviations, and the covariance of what comes out is measured and told.

Distinct vectors are combined before the shuffle, so copies of one vector don't meet; only counts, sums by dimension and the decomposition of a dimensions by dimensions matrix come to
the driver, none of which grows with the rows. Each row is then projected where it lies.

As many singular values are asked for as make MLlib decompose the Gram matrix by LAPACK, whose eigenvectors are right to double precision; its iteration for few of them stops at 1e-10.

Defined results: rows whose vector is null, or holds a null, a NaN or an infinity, are gone; vectors shorter than the longest count as ending in zeros; entries too large for a long are the largest long, or the
least; a null key passes through; repeated rows give repeated results; other columns are ignored, whatever their names. A component whose variance is under VARIANCE of the largest is rounding and is left out, so
fewer than two distinct vectors, or none, give no rows, and ``identity_error`` is over the components that are there. A deviation that doesn't fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, ship

#: Steps of an entry's unit.
SCALE = 256
#: The least variance of a component, as a part of the largest's; eigenvalues below are rounding.
VARIANCE = 1e-12
#: A whole number is summed in parts of so many bits, so no sum of fewer than 2 ** 42 rows overflows.
PART_BITS = 21


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``k_`` and ``x``, the floor of SCALE times each entry, of rows whose entries are all there and finite."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    return vectors.where(F.col(vector).isNotNull() & fine).select(F.col(key).alias("k_"), F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(0).cast("long")).alias("x"))


def _padded(x: Column, d: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(x)))


def _sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension."""
    part = lambda v, k: F.sum(F.shiftright(v, k * PART_BITS) if k == 2 else F.shiftright(v, k * PART_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    each = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(*[part(F.col("v"), k).alias(f"p{k}") for k in range(3)])
    out = [0] * d
    for r in each.collect():  # a row a dimension
        out[r["i"]] = sum(r[f"p{k}"] << k * PART_BITS for k in range(3))
    return out


def _block(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, list]:
    """Of rows of whole numbers: x - S / n as doubles, each rounded once, and the sums of (n * x - S) squared, as doubles and exact."""
    most = n * max((abs(int(v)) for v in (x.min(), x.max())), default=0) + max(map(abs, sums))
    if most < 1 << 53 and x.shape[1] * most * most < 1 << 63:
        own = x * n - np.asarray(sums, np.int64)
        exact = (own * own).sum(axis=1)
        return own / n, exact.astype(np.float64), exact.tolist()
    own = x.astype(object) * n - np.asarray(sums, object)
    exact = [sum(v * v for v in row) for row in own.tolist()]
    return (own / n).astype(np.float64), np.asarray([float(e) for e in exact]), [e if e < 1 << 63 else None for e in exact]


@dataclass
class Whitening:
    """What was fitted: n distinct vectors of d dimensions, their sums, unit components as columns with their variances, largest first, the total variance and the measured error."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float = 0.0
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Whitened rows, and their deviations."""
        centred, rough, exact = _deviations(x, self.n, self.sums)
        return centred @ self.components / np.sqrt(self.variances), rough, exact


def _svd(fit: DataFrame, n: int, sums: list[int], components: int) -> tuple[np.ndarray, np.ndarray]:
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    d = len(sums)
    means = F.array(*[F.lit(s / n) for s in sums])
    rows = fit.select(array_to_vector(F.zip_with("x", means, lambda v, m: v - m)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, d)
    # From a third of the dimensions on (of many: a half), MLlib decomposes the Gram matrix by LAPACK.
    k = min(d, max(components, d // 3 + 1 if d < 100 else d // 2 + 1))
    found = matrix.computeSVD(k, computeU=False, rCond=1e-9)
    values = np.asarray(found.s.toArray()) / np.sqrt(n)
    variances, vectors = values**2, np.asarray(found.V.toArray())
    keep = [i for i in range(min(components, len(variances))) if variances[i] > VARIANCE * variances[0]]
    return vectors[:, keep], variances[keep]


def fit_whitening(fit: DataFrame, d: int, components: int = 4) -> Whitening | None:
    """The components of the distinct vectors ``fit`` (x, of d whole numbers each); None where nothing varies."""
    n = fit.count()
    if n < 2 or d == 0:
        return None
    ship(fit.sparkSession)
    sums = _sums(fit, d)
    w = Whitening(n, sums, *_svd(fit, n, sums, components))
    k = len(w.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made, rough, _ = w.apply(_block(batch.column(0), d))
                yield pa.RecordBatch.from_arrays([pa.array(rough), *[pa.array(made[:, i]) for i in range(k)]], names=["dev", *[f"w{i}" for i in range(k)]])

    done = fit.mapInArrow(run, ", ".join(["dev double", *[f"w{i} double" for i in range(k)]]))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    told = done.agg(F.sum("dev").alias("dev"), *[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    w.total = told["dev"] / n / n / n
    w.identity_error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return w


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each remaining row and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, key, vector)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select("k_", _padded(F.col("x"), d).alias("x"))
    kind = vectors.schema[key].dataType
    schema = f"k_ {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit_whitening(cut(rows.select("x").distinct(), "vectors"), d, components)
    if w is None:
        return spark.createDataFrame([], schema).withColumnRenamed("k_", key)
    k, explained = len(w.variances), w.variances / w.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made, _, exact = w.apply(_block(batch.column(1), d))
            m = batch.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(exact, pa.int64()).take(at),
                pa.array(made.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["k_", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k_", key)
